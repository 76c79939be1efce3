"""Texts that were cut off, by a self-join on prefixes.

What was cut is a strict prefix of something longer. Three self-joins look for the
longer copies of a text's end: whole texts are sorted, so that a strict prefix stands
before what goes on with it; the last words of a text are joined to the places where
the same words stand elsewhere, which either go on or end there; the last word is
joined to the words it is a strict prefix of. A text is cut if its end goes on
elsewhere and, by the counts of both, all but never ends there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.spread import spread
from .hot import split_join

#: Characters of a value at least that is looked for in longer ones.
LEAST_VALUE = 32

#: Places that the share of a shorter context counts for beside the places of a longer one.
WEIGHT = 20

#: A context with a smaller share of ends goes on; one with a larger share is closed, whatever mark follows.
GOES_ON, CLOSED = 0.04, 0.5

#: A word that only ever ends texts is a fragment if words that it begins are so many times as frequent, are used so often at least, and have this share of all words.
FRAGMENT, LEAST_USES, CONTINUED = 20, 3, 2e-5

#: Characters of the prefixes that words are counted by; longer words are sorted instead.
WORD_PREFIX = 64

#: Characters at the end in which a mark is looked for; each of the marks is shorter.
MARK_SPAN = 96

#: Marks that a break leaves behind, and short forms whose full stop ends no sentence.
SHORT_FORMS = r"(?i)(?:^|[\s(])(?:e\.g|i\.e|cf|vs|fig|eq|sec|z\.B|d\.h|u\.a|p\.ej|c\.-à-d|p\. ex)\.$"
MARKS = r"(?i)(?:[\s\p{Z}\p{Cf}]*(?:\[truncated\]|\[(?:read )?more\]|\((?:read )?more\)|read more|\[\s?(?:\.{3}|…)\s?\]|\((?:\.{3}|…)\)|\.{3,}|…|�+|&#?[a-z0-9]{0,7}|</?[a-z]{0,5}|\\+))+$"
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF]))
SPACES = "".join(map(chr, [9, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
UNSEEN = "".join(map(chr, [0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF]))
SENTENCE = r"(?<=[.!?。！？])[\"”’»)]*\s+(?=[^\p{Ll}\p{N}\s])"
TOKEN = r"[\p{L}\p{M}_]+|\p{N}|\S"
WORD = r"^[\p{L}\p{M}_]"

_CONTEXTS = ("h4", "h3", "h2", "h1", "h0")


def _without_marks(df: DataFrame) -> DataFrame:
    """Adds ``body``, the text without blanks and marks at its end, and ``marked``, whether a mark was there. Marks may follow each other."""
    df = df.withColumn("bare", F.rtrim("text", F.lit(BLANKS)))
    end = F.right("bare", F.lit(MARK_SPAN))
    df = df.withColumn("gone", F.length(end) - F.length(F.regexp_replace(end, MARKS, "")))
    df = df.withColumn("body", F.when(F.col("gone") > 0, F.rtrim(F.substring("bare", F.lit(1), F.length("bare") - F.col("gone")), F.lit(BLANKS))).otherwise(F.col("bare")))
    return df.withColumn("marked", F.col("gone") > 0).drop("bare", "gone", "text")


def bodies(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, body, marked, h, n, frame): a row per text that isn't null, empty or blank; ``n`` its characters, ``frame`` whether a record, fence, code mark or short form holds its end: open, closed, or null."""
    base = _without_marks(spread(df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")))).where("body <> '' or marked")
    fences = (F.length("body") - F.length(F.replace("body", F.lit("```"), F.lit("")))) / 3
    record = F.coalesce(F.left("body", F.lit(40)).rlike(r"^[\s\p{Cf}]*[{\[]\s*(\"|&quot;|“)"), F.lit(False))
    frame = F.when(record, F.when(F.right("body", F.lit(1)).isin("}", "]"), "closed").otherwise("open")).when(fences % 2 == 1, "open")
    line = F.substring_index(F.translate("body", "\r", "\n"), "\n", -1)
    marks = F.length(line) - F.length(F.translate(line, "`", ""))
    frame = frame.when((marks % 2 == 1) & ~F.col("body").endswith("```"), "open").when(F.right("body", F.lit(16)).rlike(SHORT_FORMS), "open")
    return base.select("key", "source", "body", "marked", F.xxhash64("body").alias("h"), F.length("body").alias("n"), frame.alias("frame"))


def units(texts: DataFrame) -> DataFrame:
    """(row, h, kind, final, t) of the bodies (row, h, body): the tokens of every sentence or line, in lower case, digits as 0.

    ``kind`` says what the line is by its first sign (a list item, table row, heading, ...), its address or label, a text
    that is one line in title case, or prose; ``final`` is the last unit of its text.
    """
    clean = F.translate(F.translate("body", SPACES, " " * len(SPACES)), UNSEEN, "")
    lines = F.filter(F.transform(F.split(F.regexp_replace(clean, r"\p{N}+", "0"), r"[\r\n\x{85}\x{2028}\x{2029}]+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = texts.select("row", "h", lines.alias("lines")).withColumn("n_lines", F.size("lines"))
    rows = rows.select("row", "h", "n_lines", F.posexplode_outer("lines").alias("p", "line")).withColumn("line", F.coalesce("line", F.lit("")))
    rows = rows.withColumn("units", F.split("line", SENTENCE)).withColumn("last", F.coalesce(F.col("p") == F.col("n_lines") - 1, F.lit(True)))
    sign = F.regexp_extract("line", r"^(?:([-*•+]|0[.)])\s|([–—|#>{}\[`]))", 0)
    alone = (F.col("n_lines") == 1) & (F.size("units") == 1)
    label = F.lower(F.regexp_extract("line", r"^([\p{L}-]+(?: +[\p{L}-]+)?) *: ", 1))
    capital = F.regexp_count("line", F.lit(r"(?<![\p{L}\p{M}'’])\p{Lu}")) * 2 >= F.regexp_count("line", F.lit(r"(?<![\p{L}\p{M}'’])\p{L}"))
    kind = (
        F.when(F.col("line").rlike(r"(?i)^<?(?:https?://|www\.)"), "u").when(sign.rlike(r"\s"), "-").when(sign == "–", "—").when(sign != "", sign)
        .when(alone & capital, "t").when(label != "", F.concat(F.lit("k"), label)).otherwise("p")
    )
    rows = rows.select("row", "h", kind.alias("kind"), "last", F.size("units").alias("n_units"), F.posexplode("units").alias("q", "unit"))
    follows = (F.col("q") > 0) & F.col("kind").startswith("k")
    return rows.select("row", "h", F.when(follows, "p").otherwise(F.col("kind")).alias("kind"), (F.col("last") & (F.col("q") == F.col("n_units") - 1)).alias("final"), F.regexp_extract_all(F.lower("unit"), F.lit(TOKEN), F.lit(0)).alias("t"))


def _contexts(kind: Column, t2: Column, t1: Column, t0: Column) -> dict[str, Column]:
    """Hashes of a place in a kind of line: its last three tokens, two, one, only whether that is a word, and this for all labels together; null where it says no more than the next."""
    of = lambda n, *c: F.xxhash64(F.lit(n), *(F.coalesce(x, F.lit("")) for x in c))
    word = F.coalesce(t0.rlike(WORD), F.lit(False)).cast("string")
    labelled = F.when(F.length(kind) > 1, of(1, kind, word))
    return {"h4": of(4, kind, t2, t1, t0), "h3": of(3, kind, t1, t0), "h2": of(2, kind, t0), "h1": labelled, "h0": of(0, F.left(kind, F.lit(1)), word)}


def _at(n: int) -> Column:
    return F.try_element_at("t", F.lit(-n))


def longer_values(bodies: DataFrame) -> DataFrame:
    """(key, in_line, in_word) of the bodies (key, body) that are strict prefixes of a longer body elsewhere: whether it goes on in the same line, and whether it goes on in the same word.

    Bodies are sorted by range. What a body is a prefix of follows it at once, as all between the two start with it too;
    line ends are sorted last, so that a body that goes on in its line comes first. Bodies with a common start are
    no group of their own: they lie in as many ranges as they fill. The first body of each range is looked up for the range before.
    """
    sorted_by = F.translate("body", "\r\n", chr(0xF8FE) + chr(0xF8FF))
    placed = bodies.where("body <> ''").select(F.col("body"), sorted_by.alias("s")).repartitionByRange("s").sortWithinPartitions("s")
    placed = cut(placed.select("body", F.monotonically_increasing_id().alias("m")), "sorted").withColumn("p", F.shiftright("m", 33))
    at = Window.partitionBy("p").orderBy("m")
    firsts = placed.groupBy("p").agg(F.min_by("body", "m").alias("first"))  # a row per range
    following = firsts.select((F.row_number().over(Window.orderBy("p")) - 1).alias("before"), F.col("first"))
    ranges = firsts.select("p", F.row_number().over(Window.orderBy("p")).alias("before")).join(following, "before", "left").select("p", "first")
    found = placed.withColumn("next", F.lead("body").over(at)).join(ranges, "p").withColumn("next", F.coalesce("next", "first"))
    found = found.where((F.length("next") > F.length("body")) & F.expr("startswith(next, body)"))
    seam = F.expr("substring(next, length(body), 2)")
    made = found.select(F.length("body").alias("n"), F.xxhash64("body").alias("whole"), (~seam.rlike(r"^.?[\r\n]|[\r\n]$")).alias("in_line"), seam.rlike(r"^[\p{L}\p{N}]{2}$").alias("in_word"))
    own = bodies.where(F.length("body") >= LEAST_VALUE).select("key", F.length("body").alias("n"), F.xxhash64("body").alias("whole"))
    return own.join(made, ["n", "whole"]).select("key", "in_line", "in_word")


def _fragments(lexicon: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, known, uses) of the asked words: how often each is known as a whole word, and how often a longer word that it begins is used."""
    longer = lexicon.where("length(word) > 1").select("word", (F.col("cont") + F.col("ends")).alias("c")).where("c > 0")
    prefixes = longer.select(F.explode(F.expr(f"transform(sequence(1, least(length(word) - 1, {WORD_PREFIX})), n -> substring(word, 1, n))")).alias("word"), "c")
    uses = prefixes.join(asked.where(F.length("word") <= WORD_PREFIX), "word", "left_semi").groupBy("word").agg(F.sum("c").alias("uses"))
    # longer fragments are too rare to be counted by prefixes: what begins like them is found by sorting
    long = lexicon.where(F.length("word") > WORD_PREFIX).select(F.col("word").alias("key"), F.col("word").alias("body"))
    if not long.isEmpty():
        uses = uses.unionByName(longer_values(long).select(F.col("key").alias("word"), F.lit(LEAST_USES).cast("long").alias("uses")).distinct())
    whole = asked.join(lexicon, "word", "left").select("word", F.coalesce(F.col("cont") + F.col("ends"), F.lit(0)).alias("known"))
    return whole.join(uses, "word", "left").select("word", "known", F.coalesce("uses", F.lit(0)).alias("uses"))


def _share(places: dict[int, Column]) -> Column:
    """In which share of its places a context ends: each level's ends and places with the share of the level below, which counts for WEIGHT places."""
    share = (F.col("ends0") + 0.5) / (places[0] + 1)
    for j in range(1, 5):
        share = (F.col(f"ends{j}") + WEIGHT * share) / (places[j] + WEIGHT)
    return share


def _after(level: int) -> Column:
    """The hash of what stands before the last word: two words, one, or the kind of line alone."""
    before = {4: ("t2", "t1"), 3: ("t1",), 2: ()}[level]
    return F.xxhash64(F.lit(level), "kind", *(F.coalesce(x, F.lit("")) for x in before))


def _continued(grams: DataFrame, lexicon: DataFrame, asked: DataFrame) -> DataFrame:
    """(h4, longer4, longer3, longer2) of the asked ends: how often a longer word that begins with their last one follows the same words. Words are joined by their prefixes, and only where the words before are asked for."""
    levels = (4, 3, 2)
    want = cut(asked.select("h4", "word", F.explode(F.array(*(F.struct(F.lit(j).alias("level"), _after(j).alias("g")) for j in levels))).alias("x")).select("h4", "word", "x.*"), "asked")
    held = grams.where(F.col("t0").rlike(WORD) & (F.length("t0") > 1)).select("t0", (F.col("cont") + F.col("ends")).alias("n"), F.explode(F.array(_after(4), _after(3))).alias("g"))
    held = held.unionByName(lexicon.where(F.length("word") > 1).select(F.col("word").alias("t0"), (F.col("cont") + F.col("ends")).alias("n"), _after(2).alias("g")))
    held = held.join(want.select("g").distinct(), "g", "left_semi").groupBy("g", "t0").agg(F.sum("n").alias("n"))
    held = held.select("g", "n", F.explode(F.expr(f"transform(sequence(1, least(length(t0) - 1, {WORD_PREFIX})), n -> substring(t0, 1, n))")).alias("word")).groupBy("g", "word").agg(F.sum("n").alias("n"))
    met = want.join(held, ["g", "word"])
    return met.groupBy("h4").agg(*(F.max(F.when(F.col("level") == j, F.col("n"))).alias(f"longer{j}") for j in levels))


def truncated(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, cut, marked, framed, in_value, in_word, level, share): a row per text that isn't null, empty or blank.

    ``cut``: the text stops within a word or before its last sentence is finished. ``marked``: a mark of the break
    follows. ``framed``: a bracket or fence round its end is open, or closed. ``in_value``: the text as a whole is continued
    elsewhere. ``in_word``: its last word is none, but begins longer ones. ``level`` is how many of
    its last tokens stand together elsewhere, ``share`` in which share of these places nothing of the line or sentence
    follows; the fewer the places, the more the share of a shorter context counts. Keys may repeat; each row is judged by itself, with the others as evidence, of which equal texts
    count once where they end. Extra columns are dropped. An empty table gives no rows.
    """
    t = cut(bodies(df, key, text, source).withColumn("row", F.monotonically_increasing_id()), "texts")
    u = cut(units(t.select("row", "h", "body")), "units")

    # every place of every text: does its unit go on there, or end?
    before = F.concat(F.array(F.lit(None).cast("string")), "t")
    places = u.select("kind", "final", F.size("t").alias("n"), F.posexplode(F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), before).alias("t2"), before.alias("t1"), F.col("t").alias("t0"))).alias("p", "x")).where("p < n")
    on = (F.col("p") < F.col("n") - 1).cast("long")
    places = places.select("kind", "x.*", on.alias("cont"), (1 - on).alias("ends"), "final").where("cont = 1 or not final")
    sums = (F.sum("cont").alias("cont"), F.sum("ends").alias("ends"))
    grams = cut(places.groupBy("kind", "t2", "t1", "t0").agg(*sums), "grams")
    lexicon = cut(grams.where(F.col("t0").rlike(WORD)).groupBy("kind", F.col("t0").alias("word")).agg(*sums), "lexicon")
    counted = grams.select(F.explode(F.array(*_contexts(F.col("kind"), F.col("t2"), F.col("t1"), F.col("t0")).values())).alias("c"), "cont", "ends").where("c is not null")
    finals = u.where("final").select("row", "h", "kind", _at(3).alias("t2"), _at(2).alias("t1"), _at(1).alias("word"), *(c.alias(x) for x, c in _contexts(F.col("kind"), _at(3), _at(2), _at(1)).items()))
    finals = cut(finals, "finals")
    # equal texts end once, however often they are stored
    once = finals.groupBy("h").agg(*(F.first(c).alias(c) for c in ("word", *_CONTEXTS)))
    closing = once.select(F.explode(F.array(*_CONTEXTS)).alias("c"), F.lit(0).cast("long").alias("cont"), F.lit(1).cast("long").alias("ends")).where("c is not null")
    counts = counted.unionByName(closing).groupBy("c").agg(*sums)

    # the ends of texts, each context once, meet the counts of the same contexts elsewhere
    ends = cut(finals.select("kind", "t2", "t1", "word", *_CONTEXTS).distinct(), "ends")
    asked = ends.select("h4", F.explode(F.array(*(F.struct(F.lit(4 - j).alias("level"), F.col(c).alias("c")) for j, c in enumerate(_CONTEXTS)))).alias("x")).select("h4", "x.level", "x.c").where("c is not null").distinct()
    met = split_join(asked, counts.join(asked.select("c").distinct(), "c", "left_semi"), "c", "h4", "inner")
    # its own end is one of the ends
    of = lambda c, j: F.coalesce(F.max(F.when(F.col("level") == j, F.col(c) - 1)), F.lit(0))
    levels = met.withColumn("places", F.col("cont") + F.col("ends")).groupBy("h4").agg(*(of(c, j).alias(f"{c}{j}") for c in ("places", "ends") for j in range(5)))

    # last words that begin longer ones: everywhere, and after the same words
    words = ends.where(F.col("word").rlike(WORD)).select("word").distinct()
    stops = once.where(F.col("word").rlike(WORD)).groupBy("word").agg((F.count(F.lit(1)) - 1).alias("others"))
    total = lexicon.agg(F.sum(F.col("cont") + F.col("ends"))).first()[0] or 0
    part = (F.col("known") == 0) & (F.col("uses") >= F.greatest(F.lit(max(LEAST_USES, CONTINUED * total)), FRAGMENT * F.col("others")))
    begun = cut(_fragments(lexicon.groupBy("word").agg(*sums), words).join(stops, "word").where("uses > 0").select("word", part.alias("in_word")), "begun")
    levels = cut(split_join(ends.select("h4", "kind", "t2", "t1", "word"), begun, "word", "h4").join(levels, "h4"), "levels")
    plain = _share({j: F.col(f"places{j}") for j in range(5)})
    longer = _continued(grams, lexicon, levels.where("in_word is not null").where(plain >= GOES_ON))
    share = _share({j: F.col(f"places{j}") + (F.coalesce(F.col(f"longer{j}"), F.lit(0)) if j > 1 else 0) for j in range(5)})
    found = F.when(F.col("places4") > 0, 3).when(F.col("places3") > 0, 2).when(F.col("places2") > 0, 1).otherwise(0)
    evidence = cut(levels.join(longer, "h4", "left").select("h4", "in_word", found.alias("level"), share.alias("share")), "evidence")

    longer = cut(longer_values(t.select(F.col("row").alias("key"), "body")).groupBy("key").agg(F.bool_or("in_line").alias("in_line"), F.bool_or("in_word").alias("split")).select(F.col("key").alias("row"), "in_line", "split"), "values")
    judged = split_join(t.join(finals.select("row", "h4"), "row").drop("body"), evidence, "h4", "row").join(longer, "row", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    share = F.col("share")
    verdict = (
        F.when(F.col("frame") == "open", F.lit(True))
        .when(F.col("frame") == "closed", F.lit(False))
        .otherwise(yes("split") | yes("in_word") | (share < GOES_ON) | ((F.col("marked") | yes("in_line")) & (share < CLOSED)))
    )
    return judged.select(
        F.col("key").alias(key), F.col("source").alias(source), verdict.alias("cut"), "marked", F.col("frame").alias("framed"),
        F.col("in_line").isNotNull().alias("in_value"), yes("in_word").alias("in_word"), "level", "share",
    )


def truncation_report(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, texts, cut, share): how many texts of each source are cut; null is a source, shares are of its texts that aren't blank."""
    judged = truncated(df, key, text, source)
    counted = judged.groupBy(source).agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut"))
    return counted.select(F.col(source).alias("source"), "texts", "cut", F.round(F.col("cut") / F.col("texts"), 6).alias("share"))
