"""Personal details in free text, found by bootstrapped contextual extraction.

Entities that show by themselves (an address with an at sign, a number after
"Tel.", a house number before a known street word) are seeds. What else may be an
entity is an *instance* (the form of an address, the shape of a number, the word after a house number, the
first word of two capitalised ones) seen between *patterns* (the two words before
and the two after). Everything that comes out, seeds included, comes out by its score in the
graph. Instances and patterns form a bipartite graph, counted over
all texts, on which seed labels spread: a pattern is as trustworthy as the
instances it surrounds, an instance as the patterns around it. After a few
rounds in Spark, instances and patterns with high confidence label numbers without
a telling word, street words nobody listed, and first names; first names must also
go before many different words, as names of organisations do not.

One pass over the texts collects instances, a second one finds people by the
learned first names, which are broadcast up to ``BROADCAST_NAMES`` of them; more of them
reach the texts that hold them by a join. Candidates, shapes, patterns and surnames stay in tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.keys import plain_id
from threadloom.llm.words import INVISIBLE
from threadloom.runtime import Scratch, broadcast_if_small, hot_keys, join_hot

ROUNDS, SPREAD = 4, 0.25
#: Least confidence of a number, of an unlisted street word, of a first name.
SURE, SURE_STREET, SURE_NAME = 0.5, 0.6, 0.3
#: A first name goes before at least so many words, none of which takes more than this share.
SUCCESSORS, LARGEST_SHARE = 3, 0.5
#: Confidence of a form of address above which it is one.
SURE_EMAIL = 0.5
#: What a telling word before a number counts against the graph's scores of its shape (at most 1) and of what stands around it (at most a quarter each).
TOLD = 1.25
#: Most first names sent to every task; beyond, they are joined with the words of the texts.
BROADCAST_NAMES = 300_000

# Words that tell what kind of number follows (phone, identity, neither).
PHONE_WORDS = frozenset("tel telefon telefonnummer téléphone telefono teléfono phone call cell mobile móvil movil portable handy handynummer whatsapp text ring llámame appelle appelez ruf rufen landline sms fax".split())
ID_WORDS = frozenset("ssn social security sécu securite sécurité insurance passport passeport pasaporte reisepass pass licence license führerschein dni nif nie mrn patient member mitgliedsnummer tax steuer steuernummer ausweisnr ausweis personalausweis versichertennummer versicherungsnummer sanitaria national nhs permis permiso".split())
OTHER_WORDS = frozenset("isbn doi order ticket trial genbank version lot batch interval logged entry pmid invoice tracking bestellung pedido commande".split())
#: Words that introduce a person.
NAME_SEEDS = frozenset(("name is", "regards", "signed", "saludos", "gruß", "grüße", "cordialement", "name ist", "m appelle", "me llamo", "my ex", "here is", "thank you", "credit goes", "goes to"))
# Street words by language.
EN_STREET = "street st road rd avenue ave lane ln drive dr close terrace crescent square sq way court ct place pl boulevard blvd hill row mews gardens grove parade walk highway hwy".split()
FR_STREET = "rue avenue boulevard place chemin allée allee impasse quai route cours square passage sentier ruelle".split()
ES_STREET = "calle avenida avda plaza paseo camino travesía travesia ronda carretera callejón".split()
DE_STREET = "straße strasse str weg gasse platz allee ring ufer damm hof steig pfad grund".split()
# Words that follow "Am", "Im" and the like without being a street.
DE_TIMES = "montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz april mai juni juli august september oktober november dezember herbst sommer winter frühjahr frühling ende anfang jahr tag morgen abend nachmittag mittag".split()
# Words that stand between a number and a street word only by chance.
BETWEEN = frozenset("a an the at in on of and or to for from with by minutes hours days weeks months years people cases doses nurses of us slots percent per cent times sites pages page is was were that this my our your before after during".split())
PARTICLES = frozenset("van von der den de del di da la le du dos das ten ter zu".split())

AT = r"(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\s?[(\[{]\s?ät\s?[)\]}]\s?)"
DOT = r"(?:\s?[(\[{]\s?(?:dot|punkt|punto|point)\s?[)\]}]\s?|\s(?:dot|punkt|punto|point)\s|\.)"
EMAIL = re.compile(rf"[\w.+%-]+{AT}[\w-]+(?:{DOT}[\w-]+)+|[\w.+%-]+\s(?:at|arroba|ät)\s[\w-]+(?:\s(?:dot|punkt|punto|point)\s[\w-]+)+", re.I)
NUMBER = re.compile(
    r"(?<![\w.@/#-])(?:[A-Z]{2}\s?\d\d\s?\d\d\s?\d\d\s?[A-Z](?!\w)"
    r"|[#(]?(?:[A-Za-z]{1,4}-?)?[+(]?\d(?:\d|(?:[ ./()–-]|[ -]\(|\)[ -])(?=[\d(])|[A-Za-z](?=\d))*\d?(?:-?[A-ZÑ](?!\w))?)(?![\w@])"
)
#: The end of a sentence before what is looked at, but not of an abbreviation.
BREAK = re.compile(r"(?:(?<!\btel)(?<!\bno)(?<!\bnr)(?<!\bid)[.!?…]|:)(?=\s)|\n", re.I)
#: A house number, and what makes a street of the words behind or before it.
HOUSE = re.compile(r"(?<![\w.@/#-])\d{1,4}(?:\s?(?:bis|ter|quater)\b|\s?[a-z]\b)?(?![\w@]|[.,:/]\d|-\d)", re.I)
BEHIND = re.compile(
    r",?\s+(?:((?:[^\W\d_][\w'’.]*\s+){1,3}?)(?:" + "|".join(EN_STREET) + r")\b(?:\s+(?:" + "|".join(EN_STREET) + r")\b)?(?![-'’])"
    r"|(?:" + "|".join(FR_STREET) + r")\s+(?:(?:de\s+la|de\s+l['’]|des|du|de|d['’])\s*)?[^\W\d_][\w'’]*(?-i:\s+[A-ZÀ-Þ][\w'’]*){0,3})",
    re.I,
)
SPANISH = re.compile(r"\b(?:" + "|".join(ES_STREET) + r")\s+(?:de(?:l|\s+la|\s+los|\s+las)?\s+)?[^\W\d_]+(?:\s+[^\W\d_]+){0,2}?,?\s+(?:n[º°.o]+\s*)?$", re.I)
GERMAN = re.compile(r"(?:[^\W\d_]{3,}(?:" + "|".join(DE_STREET) + r")\.?|\b(?:am|im|zum|zur|(?:an|auf|hinter|in|bei|vor|unter)\s+(?:der|dem|den))\s+(?-i:[A-ZÄÖÜ])([^\W\d_]+))\s+$", re.I)
GERMAN_ENDS = tuple(DE_STREET) + tuple(w + "." for w in DE_STREET)
GERMAN_LEADS = frozenset("am im zum zur der dem den".split())
SPANISH_LEADS = frozenset(ES_STREET)
#: Capitalised words behind a house number of which none is a listed street word.
UNLISTED = re.compile(r",?\s+((?:[A-ZÀ-Þ][a-zß-ÿ'’]+\s+){1,2})([A-ZÀ-Þ][a-zß-ÿ]+)\b")
#: Digits close together, without which no number is long enough.
DIGITS = re.compile(r"\d\D{0,3}\d\D{0,3}\d\D{0,3}\d")
PAIR = re.compile(r"(?<![\w'’@.-])([A-ZÀ-Þ][a-zß-ÿ]{2,})[ \u00a0](?:[A-ZÀ-Þ]\.[ \u00a0])?((?:[A-ZÀ-Þ]['’])?[A-ZÀ-Þ][a-zß-ÿ]{2,}(?:-[A-ZÀ-Þ][a-zß-ÿ]+)?)(?![\w@])")
#: A word in small letters between white space. Not before a comma: there surnames in small letters outweigh those in pairs.
SMALL = re.compile(r"(?<!\S)[a-zß-ÿ]{2,}(?!\S)")
#: Words in small letters counted in a task before they are passed on.
COUNTED_WORDS = 200_000
NAME_PART = re.compile(r"[^\W\d_]+(?:['’.-][^\W\d_]+)*\.?|,")
LETTERS = re.compile(r"[^\W_]+")
ZERO = str.maketrans("123456789", "000000000")


def _visible(text: str) -> tuple[str, list[int] | None]:
    """Text without invisible characters, and where its characters stood (none: where they are)."""
    if text.isascii() or not INVISIBLE.search(text):
        return text, None
    at = [i for i, c in enumerate(text) if not INVISIBLE.match(c)]
    return "".join(text[i] for i in at), at


def _before(text: str, start: int, words: int = 4, least: int = 40) -> str:
    """What stands before in the same sentence: at least ``words`` words if there are as many, however long they are."""
    size = least
    while True:
        part = text[max(0, start - size) : start]
        ends = [m.end() for m in BREAK.finditer(part) if m[0] != ":"]
        if ends:
            return part[ends[-1] :]
        # The first word of the part may be cut.
        if size >= start or len(LETTERS.findall(part)) > words:
            return part
        size *= 4


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before and the two after within the sentence, digits as 0."""
    before = LETTERS.findall(_before(text, start).lower().translate(ZERO))[-2:]
    size = 30
    while (len(LETTERS.findall(text[end : end + size])) < 3) and end + size < len(text):
        size *= 4
    part = text[end : end + size]
    stop = BREAK.search(part)
    after = LETTERS.findall((part[: stop.start()] if stop else part).lower().translate(ZERO))[:2]
    return " ".join(before), " ".join(after)


def _number_seed(text: str, start: int) -> str | None:
    for w in reversed(LETTERS.findall(_before(text, start).lower())[-3:]):
        for kind, known in (("other", OTHER_WORDS), ("id_number", ID_WORDS), ("phone", PHONE_WORDS)):
            if w in known:
                return kind
    return None


def _shape(number: str) -> str:
    return "".join("0" if c.isdigit() else "A" if c.isalpha() else c for c in number.strip())


def _form(address: str) -> str:
    """How at and dot are written in an address."""
    return "".join(re.findall(r"[@()\[\]{}]|\b(?:at|ät|arroba|dot|punkt|punto|point)\b", address.lower())) or "@"


def candidates_of(text: str) -> list[tuple[str, int, int, str, str | None]]:
    """kind, start, end, instance, seed of what may be a detail in a (visible) text; people apart."""
    out = []
    taken: list[tuple[int, int]] = []
    low = text.lower()
    if "@" in text or "at" in low and ("(at" in low or "[at" in low or "{at" in low or " dot " in low or " punkt " in low or " punto " in low or " point " in low):
        for m in EMAIL.finditer(text):
            out.append(("email", m.start(), m.end(), _form(m[0]), "email"))
            taken.append(m.span())
    for m in HOUSE.finditer(text):
        street = _street(text, *m.span())
        if street:
            span, form = street[:2], street[2]
            if not any(a < span[1] and span[0] < b for a, b in taken):
                out.append(("street_address", *span, form, "street_address"))
                taken.append(span)
            continue
        u = UNLISTED.match(text, m.end())
        if u:
            out.append(("street", m.start(), u.end(), u[2].lower(), None))
    if DIGITS.search(text):
        for m in NUMBER.finditer(text):
            digits = sum(c.isdigit() for c in m[0])
            if digits >= 6 and not any(a < m.end() and m.start() < b for a, b in taken):
                number = m[0].rstrip(" (./–-")
                out.append(("number", m.start(), m.start() + len(number), _shape(number), _number_seed(text, m.start())))
    return out


def _street(text: str, start: int, end: int) -> tuple[int, int, str] | None:
    """The span of a street with the house number at start:end and its form, if there is one."""
    m = BEHIND.match(text, end)
    if m and not (m[1] and any(w.strip(".").lower() in BETWEEN for w in m[1].split())):
        return start, m.end(), "\x00en" if m[1] else "\x00fr"
    # Seven words: those of the longest form and one that may be cut.
    size = 60
    while size < start and len(text[max(0, start - size) : start].split()) < 7:
        size *= 4
    before = text[max(0, start - size) : start]
    words = before.lower().replace(",", " ").split()[-6:]
    if not words:
        return None
    if words[-1].endswith(GERMAN_ENDS) or not GERMAN_LEADS.isdisjoint(words[-2:-1]):
        m = GERMAN.search(before)
        if m and (m[1] is None or m.end(1) - m.start(1) > 3 and before[m.start(1) - 1 : m.end(1)].lower() not in DE_TIMES):
            return start - len(before) + m.start(), end, "\x00de"
    if not SPANISH_LEADS.isdisjoint(words):
        m = SPANISH.search(before)
        if m:
            return start - len(before) + m.start(), end, "\x00es"
    return None


COLUMNS = "kind string, field_name string, record_id string, text_key bigint, start int, stop int, instance string, seed string, before string, after string, follower string, n bigint"


def _collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates with their places, and counts of capitalised pairs with their surroundings and of words in small letters."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}
        # Keys are 64-bit numbers: they must not pass through floating point.
        whole = {"text_key": "Int64", "start": "Int32", "stop": "Int32", "n": "Int64"}
        return pd.DataFrame({n: pd.array(list(columns[n]), dtype=whole[n]) if n in whole else pd.Series(list(columns[n]), dtype=object) for n in names})

    def counted(lower: Counter) -> pd.DataFrame:
        return framed([("lower", None, None, None, None, None, g, None, None, None, None, n) for g, n in lower.items()])

    lower: Counter = Counter()
    for pdf in batches:
        rows: list[tuple] = []
        pairs: Counter = Counter()
        for field, record, key, text in zip(pdf["field_name"], pdf["record_id"], pdf["text_key"], pdf["text"]):
            text, _ = _visible(text)
            for kind, start, end, instance, seed in candidates_of(text):
                before, after = _around(text, start, end)
                kind = "street" if kind == "street_address" else kind  # listed and other streets share one graph
                rows.append((kind, field, record, key, start, end, instance, seed, before, after, None, 1))
            for m in PAIR.finditer(text):
                before, after = _around(text, m.start(), m.end())
                pairs[(m[1].lower(), m[2].lower(), before, after)] += 1
            lower.update(SMALL.findall(text))
        rows += [("pair", None, None, None, None, None, g, "name" if b in NAME_SEEDS or b.rpartition(" ")[2] in NAME_SEEDS else None, b, a, _stem(s), n) for (g, s, b, a), n in pairs.items()]
        yield framed(rows)
        if len(lower) > COUNTED_WORDS:
            yield counted(lower)
            lower.clear()
    yield counted(lower)


def _stem(surname: str) -> str:
    """The last part of a surname with hyphens or an apostrophe."""
    return re.split(r"['’-]", surname)[-1]


def spread(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Confidences of instances and of patterns on a counted graph.

    edges: kind, instance, pattern, n. seeds: kind, instance, type, n. Returns
    (kind, instance, type, score) and (kind, pattern, type, score).
    """
    key = ["kind", "instance"]
    mass = edges.groupBy(key).agg(F.sum("n").alias("_mass"))
    weight = edges.groupBy("kind", "pattern").agg(F.sum("n").alias("_weight"))
    base = seeds.groupBy(key).agg(F.sum("n").alias("_seeds"))
    scores = seeds.join(base, key).select(*key, "type", (F.col("n") / F.col("_seeds")).alias("score"))
    scores = scratch.keep(scores)
    patterns = scores
    for _ in range(rounds):
        up = edges.join(broadcast_if_small(scores), key).groupBy("kind", "pattern", "type").agg(F.sum(F.col("n") * F.col("score")).alias("_s"))
        patterns = scratch.keep(up.join(weight, ["kind", "pattern"]).select("kind", "pattern", "type", (F.col("_s") / F.col("_weight")).alias("score")))
        down = edges.join(patterns, ["kind", "pattern"]).groupBy(*key, "type").agg((SPREAD * F.sum(F.col("n") * F.col("score"))).alias("_s"))
        own = seeds.select(*key, "type", F.col("n").cast("double").alias("_s"))
        total = mass.join(base, key, "left").select(*key, (F.coalesce("_seeds", F.lit(0)) + SPREAD * F.col("_mass")).alias("_t"))
        scores = down.unionByName(own).groupBy(*key, "type").agg(F.sum("_s").alias("_s")).join(total, key)
        scores = scratch.keep(scores.select(*key, "type", (F.col("_s") / F.col("_t")).alias("score")))
    return scores, patterns


def texts_of(comments: DataFrame) -> DataFrame:
    """field_name, record_id, text_key, text of bodies and titles; null texts are left out, null ids are not."""
    body = comments.select(F.lit("body").alias("field_name"), plain_id(F.col("comment_id").cast("string")).alias("record_id"), F.col("body").cast("string").alias("text"))
    title = comments.select(F.lit("submission_title").alias("field_name"), plain_id(F.col("submission_id").cast("string")).alias("record_id"), F.col("submission_title").cast("string").alias("text")).distinct()
    both = body.unionByName(title).filter(F.col("text").isNotNull() & (F.col("text") != ""))
    return both.select("field_name", "record_id", F.xxhash64("text").alias("text_key"), "text")


def common_words(pairs: DataFrame, lower: DataFrame) -> DataFrame:
    """word: words of capitalised pairs that are seen more often in small letters."""
    sides = F.explode(F.array("instance", "follower")).alias("word")
    capital = pairs.select("n", sides).groupBy("word").agg(F.sum("n").alias("_capital"))
    low = lower.groupBy(F.col("instance").alias("word")).agg(F.sum("n").alias("_low"))
    return low.join(capital, "word").filter(F.col("_low") > F.col("_capital")).select("word")


def first_names(pairs: DataFrame, common: DataFrame, scores: DataFrame) -> DataFrame:
    """instance, n: words that behave like first names."""
    follow = pairs.groupBy("instance", "follower").agg(F.sum("n").alias("n"))
    follow = follow.join(common.select(F.col("word").alias("follower"), F.lit(True).alias("_common")), "follower", "left")
    shape = follow.groupBy("instance").agg(F.sum("n").alias("n"), F.count_if(F.col("_common").isNull()).alias("followers"), F.max("n").alias("most"), F.sum(F.when(F.col("_common"), F.col("n")).otherwise(0)).alias("dull"))
    sure = scores.filter((F.col("kind") == "pair") & (F.col("type") == "name") & (F.col("score") >= SURE_NAME)).select("instance")
    shape = shape.join(common.select(F.col("word").alias("instance")), "instance", "left_anti").join(sure, "instance", "left_semi")
    ok = (F.col("followers") >= SUCCESSORS) & (F.col("most") <= LARGEST_SHARE * F.col("n")) & (F.col("dull") <= LARGEST_SHARE * F.col("n"))
    return shape.filter(ok).select("instance", "n")


def people_of(text: str, given: frozenset[str]) -> list[tuple[int, int, str, bool]]:
    """start, end, surname, capitalised of what may be given name and surname together."""
    out = []
    parts = [(m[0], m.start(), m.end()) for m in NAME_PART.finditer(text)]
    bare = [p[0].rstrip(".").lower() for p in parts]
    i = 0
    while i < len(parts):
        if bare[i] not in given:
            i += 1
            continue
        start, j = i, i + 1
        # Surname first: "Ferranen, Kofi".
        if i >= 2 and parts[i - 1][0] == "," and len(bare[i - 2]) > 3 and bare[i - 2] not in given and (i < 3 or bare[i - 3] not in given):
            out.append((parts[i - 2][1], parts[i][2], _stem(bare[i - 2]), False))
        while j < len(parts) and text[parts[j - 1][2] : parts[j][1]].strip() == "" and (bare[j] in given or (len(bare[j]) == 1 and parts[j][0].endswith("."))):
            j += 1
        k = j
        while k < len(parts) and bare[k] in PARTICLES and k - j < 3:
            k += 1
        if k < len(parts) and parts[k][0] != "," and text[parts[k - 1][2] : parts[k][1]].strip() == "" and (parts[k - 1][0][-1:] != "." or len(bare[k - 1]) == 1) and len(bare[k]) > 2:
            out.append((parts[start][1], parts[k][2] - parts[k][0].endswith("."), _stem(bare[k]), parts[k][0][0].isupper()))
            i = k + 1
        else:
            i = j
    return out


PEOPLE = "field_name string, record_id string, text_key bigint, start int, stop int, surname string, capital boolean"
#: A run of letters, as the texts are searched for first names.
RUN_OF_LETTERS = re.compile(r"[^\W\d_]+")


def _people(shared):
    """Finds people by the first names of a broadcast, or by those that come with each text (column ``given``)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: frozenset[str] = shared.value if shared is not None else frozenset()
        for pdf in batches:
            rows = []
            own = pdf["given"] if shared is None else [known] * len(pdf)
            for field, record, key, text, given in zip(pdf["field_name"], pdf["record_id"], pdf["text_key"], pdf["text"], own):
                text, _ = _visible(text)
                given = given if shared is not None else frozenset(given)
                if given.isdisjoint(RUN_OF_LETTERS.findall(text.lower())):
                    continue
                mails = [m.span() for m in EMAIL.finditer(text)] if "@" in text or "at" in text else []
                for start, end, surname, capital in people_of(text, given):
                    if not any(a < end and start < b for a, b in mails):
                        rows.append((field, record, key, start, end, surname, capital))
            yield pd.DataFrame(rows, columns=["field_name", "record_id", "text_key", "start", "stop", "surname", "capital"]).astype({"text_key": "int64", "start": "int32", "stop": "int32", "capital": bool})

    return find


@F.pandas_udf(T.ArrayType(T.StringType()))
def _letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: sorted(set(RUN_OF_LETTERS.findall(_visible(t)[0].lower()))))


def people(texts: DataFrame, firsts: DataFrame, scratch: Scratch, limit: int = BROADCAST_NAMES) -> DataFrame:
    """Candidate people (``PEOPLE``) in texts by first names (instance); few names are broadcast, many are joined."""
    n = firsts.count()
    if not n:
        return texts.sparkSession.createDataFrame([], PEOPLE)
    if n <= limit:
        known = texts.sparkSession.sparkContext.broadcast(frozenset(r["instance"] for r in firsts.collect()))
        return texts.mapInPandas(_people(known), PEOPLE)
    # A name that a third of all texts hold is one row of the names, and its texts are pairs of its join: hot ones are split off.
    distinct = texts.select("text_key", "text").distinct()
    held = scratch.keep(distinct.select("text_key", F.explode(_letters("text")).alias("instance")))
    per = join_hot(held, firsts, "instance", hot_keys(held, "instance"), "left_semi").groupBy("text_key").agg(F.collect_set("instance").alias("given"))  # no more than a text has words
    return texts.join(per, "text_key").mapInPandas(_people(None), PEOPLE)


def find_details(comments: DataFrame) -> DataFrame:
    """field_name, record_id, text_key, start, stop, pii_type: every detail with its place.

    Places count the characters of the text without invisible ones; ``text_key``
    is the xxhash64 of the text. Ids are trimmed, lower-cased and without
    ``t1_``/``t3_``. Null texts give nothing, texts of null ids have a null record_id; repeated rows give their
    details once per distinct text and record after ``found``. Without any seed
    nothing but what shows by itself is found. Extra columns are not read.
    """
    spark = comments.sparkSession
    scratch = Scratch(spark, "details")
    texts = texts_of(comments)
    seen = scratch.keep(texts.mapInPandas(_collect, COLUMNS))
    cols = ["field_name", "record_id", "text_key", "start", "stop"]

    graph = seen.filter(F.col("kind").isin("email", "number", "street", "pair"))
    sides = graph.select("kind", "instance", "n", F.explode(F.array(F.concat(F.lit("L "), "before"), F.concat(F.lit("R "), "after"))).alias("pattern"))
    edges = scratch.keep(sides.groupBy("kind", "instance", "pattern").agg(F.sum("n").alias("n")))
    told = graph.filter(F.col("seed").isNotNull()).groupBy("kind", "instance", F.col("seed").alias("type")).agg(F.sum("n").alias("n"))
    seeds = scratch.keep(told)
    scores, patterns = spread(edges, seeds, scratch)

    numbers = seen.filter(F.col("kind") == "number")
    vote = lambda t: F.when(F.col("seed") == t, TOLD).otherwise(0.0)
    wide_i = scores.filter(F.col("kind") == "number").groupBy("instance").agg(*[F.max(F.when(F.col("type") == t, F.col("score"))).alias(f"i_{t}") for t in ("phone", "id_number", "other")])
    wide_p = patterns.filter(F.col("kind") == "number").groupBy("pattern").agg(*[F.max(F.when(F.col("type") == t, F.col("score"))).alias(f"p_{t}") for t in ("phone", "id_number", "other")])
    left = wide_p.select(F.col("pattern").alias("_l"), *[F.col(f"p_{t}").alias(f"l_{t}") for t in ("phone", "id_number", "other")])
    right = wide_p.select(F.col("pattern").alias("_r"), *[F.col(f"p_{t}").alias(f"r_{t}") for t in ("phone", "id_number", "other")])
    judged = numbers.withColumn("_l", F.concat(F.lit("L "), "before")).withColumn("_r", F.concat(F.lit("R "), "after")).join(wide_i, "instance", "left").join(left, "_l", "left").join(right, "_r", "left")
    s: dict[str, Column] = {t: vote(t) + F.coalesce(f"i_{t}", F.lit(0.0)) + 0.25 * F.coalesce(f"l_{t}", F.lit(0.0)) + 0.25 * F.coalesce(f"r_{t}", F.lit(0.0)) for t in ("phone", "id_number", "other")}
    best = F.greatest(*s.values())
    kind = F.when(best < SURE, None).when(s["other"] == best, None).when(s["phone"] == best, "phone").otherwise("id_number")
    told_numbers = judged.select(*cols, kind.alias("pii_type")).filter(F.col("pii_type").isNotNull())

    # Forms of addresses and words of streets by their score, listed ones as well as others.
    by_score = lambda kind, t, sure: seen.filter(F.col("kind") == kind).join(broadcast_if_small(scores.filter((F.col("kind") == kind) & (F.col("type") == t) & (F.col("score") >= sure)).select("instance")), "instance", "left_semi").select(*cols, F.lit(t).alias("pii_type"))
    plain = by_score("email", "email", SURE_EMAIL).unionByName(by_score("street", "street_address", SURE_STREET))

    pairs = seen.filter(F.col("kind") == "pair").groupBy("instance", "follower").agg(F.sum("n").alias("n"))
    pairs = scratch.keep(pairs)
    common = scratch.keep(common_words(pairs, seen.filter(F.col("kind") == "lower").select("instance", "n")))
    firsts = scratch.keep(first_names(pairs, common, scores).select("instance"))
    seen_people = people(texts, firsts, scratch)
    # In capitals any word but a common one is a surname; otherwise it must have been seen in capitals after a first name.
    learned = pairs.join(broadcast_if_small(firsts), "instance", "left_semi").select(F.col("follower").alias("surname")).distinct().join(common.select(F.col("word").alias("surname")), "surname", "left_anti").withColumn("_seen", F.lit(True))
    named = seen_people.join(common.select(F.col("word").alias("surname")), "surname", "left_anti").join(learned, "surname", "left").filter(F.col("capital") | F.col("_seen"))
    return plain.unionByName(told_numbers).unionByName(named.select(*cols, F.lit("person_name").alias("pii_type")))


def found(details: DataFrame) -> DataFrame:
    """field_name, record_id, pii_type of records that have an id."""
    return details.filter(F.col("record_id").isNotNull()).select("field_name", "record_id", "pii_type").distinct()


def redact(comments: DataFrame, details: DataFrame) -> DataFrame:
    """field_name, record_id, text, redacted of every distinct text that holds a detail.

    Each detail becomes ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``,
    ``[STREET_ADDRESS]`` or ``[PERSON_NAME]``; overlapping ones become one, of the
    type that begins first (the longer one if both begin alike). All other
    characters stay as they were. Texts without an id come out with a null record_id.
    """
    spans = details.groupBy("field_name", "record_id", "text_key").agg(F.collect_set(F.struct("start", "stop", "pii_type")).alias("spans"))  # as many as one text holds
    t, d = texts_of(comments).distinct().alias("t"), spans.alias("d")
    same = (F.col("t.field_name") == F.col("d.field_name")) & F.col("t.record_id").eqNullSafe(F.col("d.record_id")) & (F.col("t.text_key") == F.col("d.text_key"))
    hit = t.join(d, same).select("t.*", "d.spans")

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(redacted=[placeholders(t, [(s["start"], s["stop"], s["pii_type"]) for s in ss]) for t, ss in zip(pdf["text"], pdf["spans"])])[["field_name", "record_id", "text", "redacted"]]

    return hit.mapInPandas(replace, "field_name string, record_id string, text string, redacted string")


def placeholders(text: str, spans: list[tuple[int, int, str]]) -> str:
    seen, at = _visible(text)
    place = lambda i: i if at is None else (at[i] if i < len(at) else len(text))
    out, last = [], 0
    for start, stop, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        a, b = place(start), place(stop - 1) + 1
        if a < last:
            last = max(last, b)
            continue
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])
