import random

from threadloom.llm import pii


def kinds(text):
    return {(k, text[a:b]) for k, a, b, *_ in pii.candidates_of(text)}


def test_shapes():
    assert ("email", "a.b+c@mail.example.org") in kinds("write a.b+c@mail.example.org now")
    assert ("email", "bob (at) post.test") in kinds("ask bob (at) post.test please")
    assert ("email", "bob at post dot example dot org") in kinds("ask bob at post dot example dot org please")
    assert not any(k == "email" for k, _ in kinds("The @ sign, look at example and @OP"))
    for t in ("12 Old Mill Ave", "7 bis, rue des Lilas", "Calle del Olmo Viejo, nº 23", "Lindenstraße 40b", "Am Weidenbach 12", "Hinter der Walke 9"):
        assert any(k == "street_address" for k, _ in kinds(f"I live at {t}, blue door")), t
    for t in ("The clinic on Old Mill Ave was closed", "It took 20 minutes at a drive-through tent", "am Dienstag 12 Leute", "see page 12"):
        assert not any(k == "street_address" for k, _ in kinds(t)), t
    assert ("number", "+49 (0)30 23125-403") in kinds("Tel. +49 (0)30 23125-403")
    assert ("number", "QQ 26 55 95 C") in kinds("number: QQ 26 55 95 C.")


def corpus(seed=1):
    rnd = random.Random(seed)
    first, last = ["Mina", "Kofi", "Petra", "Linus"], ["Hartwick", "Brandvell", "Osterlo", "Tarnbeck", "Quillon", "Melgard"]
    lines = []
    for _ in range(60):
        f, s = rnd.choice(first), rnd.choice(last)
        lines.append(rnd.choice([f"my name is {f} {s} and more", f"Regards, {f} {s}", f"we saw {f} {s} at the site", f"my name is Old Quarry and more"]))
        n = rnd.randrange(10**8)
        lines.append(rnd.choice([f"call me on 0{n:08d}9 today", f"SSN 9{n % 90:02d}-{n % 80:02d}-{n % 9000 + 1000}", f"Order #{n:08d} arrived late", f"I typed 9{n % 90:02d}-{n % 80:02d}-{n % 9000 + 1000} there"]))
    return lines


def frame(spark, bodies, titles=None):
    return spark.createDataFrame([(f"T1_c{k}", b, "t3_s", (titles or {}).get(k), "x", 1) for k, b in enumerate(bodies)], "comment_id string, body string, submission_id string, submission_title string, instance string, start int")


def test_bootstraps_names_and_numbers(spark):
    lines = corpus() + ["then kofi hartwick spoke", "Brandvell, Petra", "I met Kofi yesterday", "Old Quarry spoke", None, "", "x" * 200_000]
    got = {(r.record_id, r.pii_type) for r in pii.found(pii.find_details(frame(spark, lines, {0: "mail a@b.example"}))).collect()}
    n = len(lines)
    assert (f"c{n - 7}", "person_name") in got and (f"c{n - 6}", "person_name") in got
    assert not {(f"c{n - 5}", "person_name"), (f"c{n - 4}", "person_name")} & got
    assert ("s", "email") in got
    for k, line in enumerate(lines[:-7]):
        want = {"typed": "id_number", "SSN": "id_number", "call me": "phone", "Regards": "person_name", "we saw": "person_name"}
        for word, kind in want.items():
            if word in line:
                assert (f"c{k}", kind) in got, line
        if "Order" in line or "Old Quarry" in line:
            assert not [g for g in got if g[0] == f"c{k}"], line


def test_empty_tables(spark):
    assert pii.find_details(frame(spark, ["a"]).limit(0)).count() == 0
    assert pii.found(pii.find_details(frame(spark, ["nothing here"]))).count() == 0


def test_placeholders_keep_the_rest(spark):
    assert pii.placeholders("ab​c 12 d", [(0, 3, "email")]) == "[EMAIL] 12 d"
    assert pii.placeholders("abcdef", [(1, 4, "phone"), (2, 5, "email")]) == "a[PHONE]f"
    comments = frame(spark, ["mail a@b.example, thanks", "mail a@b.example, thanks", "none"])
    got = {(r.record_id, r.redacted) for r in pii.redact(comments, pii.find_details(comments)).collect()}
    assert got == {("c0", "mail [EMAIL], thanks"), ("c1", "mail [EMAIL], thanks")}


def test_common_words_do_not_depend_on_batches(spark, monkeypatch):
    """Small letters count in texts far from the capitalised pairs."""
    lines = [f"Regards, Thanks {s}" for s in ("Hartwick", "Brandvell", "Osterlo", "Tarnbeck")] * 2 + ["many thanks to all"] * 15 + ["nothing more"] * 40
    seen = []
    monkeypatch.setattr(pii, "first_names", lambda pairs, common, scores, f=pii.first_names: seen.append({r.word for r in common.collect()}) or f(pairs, common, scores))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("10000", "3"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            details = pii.find_details(frame(spark, lines))
            assert not [r for r in pii.found(details).collect() if r.pii_type == "person_name"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert seen == [{"thanks"}] * 2


def test_redacts_texts_without_id(spark):
    cols = "comment_id string, body string, submission_id string, submission_title string"
    comments = spark.createDataFrame([("c0", "x", None, "mail a@b.example"), ("c1", "y", " ", "mail a@b.example"), (None, "ask c@d.example", "s", "mail a@b.example"), ("c2", None, None, None)], cols)
    details = pii.find_details(comments)
    got = sorted((r.field_name, r.record_id or "", r.redacted) for r in pii.redact(comments, details).collect())
    assert got == [("body", "", "ask [EMAIL]"), ("submission_title", "", "mail [EMAIL]"), ("submission_title", "s", "mail [EMAIL]")]
    assert {tuple(r) for r in pii.found(details).collect()} == {("submission_title", "s", "email")}


def test_joined_first_names_and_partitions(spark, rows):
    """More names than may be broadcast are joined; neither that nor partitions and batches change what is found."""
    from threadloom.runtime import Scratch

    texts = [f"my name is {g} {s}, call me" for g in ("Anna", "Boris", "Carla", "Dmitri") for s in ("Velko", "Norrin", "Ostrava", "Palmer")] + ["Thanks, Anna Maria Velko!", "nothing here", "ask Palmer, Carla"]
    frame = spark.createDataFrame([(f"c{k}", t, None, None) for k, t in enumerate(texts * 3)], "comment_id string, body string, submission_id string, submission_title string")
    want = rows(pii.found(pii.find_details(frame.coalesce(1))))
    assert len(want) > 40 and rows(pii.found(pii.find_details(frame.repartition(7)))) == want
    own, names = pii.texts_of(frame), spark.createDataFrame([(g,) for g in ("anna", "boris", "carla", "dmitri", "maria")], "instance string")
    assert rows(pii.people(own, names, Scratch(spark, "t"), limit=2)) == rows(pii.people(own, names, Scratch(spark, "t")))


def test_contexts_are_not_cut():
    """Words longer than any fixed window still count as the two before and after."""
    long = "x" * 300
    text = f"tel {long} 12345678 {long} end now"
    assert pii._around(text, text.index("12345678"), text.index("12345678") + 8) == (f"tel {long}", f"{long} end")
    street = f"Calle de {'ramo' * 30} {'verde' * 20} 14"
    assert pii.candidates_of(street)[0][:3] == ("street_address", 0, len(street))
