"""Quality rules: base counts of a text, and how far its make-up diverges from that of its language.

For each document two histograms are counted: code points by character class, and the words of its language's list of
common words, the rest of the words in one bin. Lists and references are fitted apart from what they judge: documents
fall in two folds by a hash of their id, and those of one fold that pass the base rules give, by language, the `COMMON`
words that most documents hold and the shares of all bins, to which documents of the other fold are held. A document
goes when a Jensen-Shannon distance (square root of the divergence in bits) is over its limit, unless it is too short
for that histogram to mean anything.

The limit of the words follows from the documents: by chance alone short texts stand further off than long ones, so
distances are held against their own spread among the texts of the language that are as long (within a factor of two),
by a histogram of them.

Results for odd input: a null or blank text has no words and fails the base rules; a null lang is a language of its
own; a language with fewer than `LEAST_DOCS` good documents in the other fold is judged by the base rules alone, and
lengths with fewer than that by the classes too; a null id falls in the first fold; rows that share an id get one row each; further columns are ignored, and keep_good() keeps
them, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapsync.llm.common import free_names, words_of, written

#: Words of a list.
COMMON = 100
#: Character classes that are counted, with the pattern of what is not in them. White space is another, and the rest.
CLASSES = (("upper", r"\P{Lu}+"), ("digit", r"\P{Nd}+"), ("symbol", r"[^#*$%&|<>]+"), ("mark", r"[^.,;:!?'\"()-]+"))
#: Limit of the class distance, and the code points below which it isn't asked.
CLASS_LIMIT, LEAST_CHARS = 0.32, 300
#: The least words of a text that is asked, the length (in binary digits of the number of words) from which all count as
#: one, how many times the way from the 10 % quantile to the median the limit lies above the median, the steps of the
#: histogram of distances in 1, and the good documents below which a language or a length is no reference.
ASKED_WORDS, LONGEST_SIZE, SPREADS, STEPS, LEAST_DOCS = 50, 12, 3, 1000, 30
#: References up to this number of languages are sent to all tasks.
FEW_LANGS = 1_000
#: Texts of up to 2**PLACE_BITS words sort their windows as plain numbers.
PLACE_BITS = 20


def _without_commonest(text: Column) -> Column:
    """text without small letters and spaces, which are in no class."""
    return F.regexp_replace(text, r"[\p{Ll}\x20]+", "")


def _counts_of_classes(text: Column) -> list[Column]:
    """Code points in each class: what is left when the runs of all others are cut out."""
    return [F.length(F.regexp_replace(text, others, "")) for _, others in CLASSES]


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_window_words(words: Column, size: int = 5) -> Column:
    """Words under windows of so many words that stand twice or more in the array; equal windows have equal hashes."""
    none = F.array().cast("array<bigint>")
    windows = lambda h: F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size))))).otherwise(none)
    count = lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w, size))
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count))


def _covered(windows: Column, size: int) -> Column:
    # Places sort by hash, as numbers whose low bits hold the place; neighbours compare by their whole hashes.
    low = F.lit((1 << PLACE_BITS) - 1).cast("bigint")
    packed = F.when(F.size(windows) <= (1 << PLACE_BITS), F.transform(F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("bigint")))), lambda x: x.bitwiseAND(low).cast("int")))
    by_hash = F.coalesce(packed, F.transform(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda x: x["i"]))
    hash_at = lambda order, j: F.get(windows, F.get(order, j))
    same = lambda order, x, j: F.coalesce(hash_at(order, j) == F.get(windows, x), F.lit(False))
    twice = lambda order: F.filter(order, lambda x, j: same(order, x, j + 1) | ((j > 0) & same(order, x, F.greatest(j - 1, F.lit(0)))))
    steps = lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size)))), F.lit(0), lambda n, x: n + x)
    return _let(by_hash, lambda order: _let(F.sort_array(twice(order)), steps))


def _last_places(words: Column) -> Column:
    """Where the runs of equal words of a sorted array end."""
    return F.array_compact(F.transform(words, lambda w, i: F.when(~w.eqNullSafe(F.get(words, i + 1)), i)))


def _counted(rows: DataFrame, *more: str) -> DataFrame:
    """more, word, n of the different words of rows, by the arrays that features() gives."""
    return rows.select(*more, "times", F.posexplode("small").alias("place", "word")).select(*more, "word", F.get("times", F.col("place")).alias("n"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lang, fold, the base counts, failed, and the two histograms of each row; words only where it hasn't failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    fold = F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1), 16, 10).cast("int") % 2, F.lit(0))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.coalesce("lang", F.lit("")).alias("lang"), fold.alias("fold"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = rows.select("*", _without_commonest(F.col("text")).alias("marks"))
    rows = rows.select(
        "doc_id", "text_key", "lang", "fold", F.length("text").alias("n_chars"), words_of(F.col("text")).alias("words"), *(c.alias(n) for (n, _), c in zip(CLASSES, _counts_of_classes(F.col("marks")))),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
    )
    rows = rows.select("*", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), repeated_window_words(F.col("words")).alias("n_repeat_words"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # Different words in order, and how often each stands: arrays in columns of their own, which Spark compiles.
    rows = rows.withColumn("base_failed", failed).withColumn("small", F.when(~F.col("base_failed"), F.sort_array(F.transform("words", F.lower))))
    rows = rows.drop("words").withColumn("last", _last_places(F.col("small")))
    classes = F.array(F.col("n_chars") - F.col("word_chars"), *(F.col(n) for n, _ in CLASSES))
    rest = F.col("n_chars") - F.aggregate(classes, F.lit(0), lambda n, x: n + x)
    times = F.transform("last", lambda x, j: x - F.coalesce(F.get("last", j - 1), F.lit(-1)))
    return rows.select(
        "doc_id", "text_key", "lang", "fold", "n_chars", "n_words", "word_chars", F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", "base_failed", F.concat(classes, F.array(rest)).alias("classes"),
        F.transform("last", lambda x: F.get("small", x)).alias("small"), times.alias("times"), F.monotonically_increasing_id().alias("row"),
    )


def references(rows: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """(lang, fold, classes: shares of the classes), (lang, fold, word, q: its share, all_q: that of the whole list).

    fold is the one that is judged: the other one of those that the numbers come from.
    """
    good = rows.where("NOT base_failed").withColumn("fold", 1 - F.col("fold"))
    n = len(CLASSES) + 2
    sums = good.groupBy("lang", "fold").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("all_words"), F.sum("n_chars").alias("all_chars"), *(F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n))).where(F.col("n_docs") >= LEAST_DOCS)
    sums = written(sums)
    classes = sums.select("lang", "fold", F.array(*(F.col(f"c{i}") / F.col("all_chars") for i in range(n))).alias("ref_classes"))
    # What is counted for all words is in how many documents they stand; how often, for those of a list alone.
    held = good.select("lang", "fold", F.explode("small").alias("word")).groupBy("lang", "fold", "word").agg(F.count(F.lit(1)).alias("in_docs"))
    first = F.row_number().over(Window.partitionBy("lang", "fold").orderBy(F.desc("in_docs"), "word"))
    top = written(held.withColumn("place", first).where(F.col("place") <= COMMON).select("lang", "fold", "word"))
    times = _counted(good, "lang", "fold").join(F.broadcast(top) if few else top, ["lang", "fold", "word"]).groupBy("lang", "fold", "word").agg(F.sum("n").alias("n"))
    lists = written(times.join(sums.select("lang", "fold", "all_words"), ["lang", "fold"]).select("lang", "fold", "word", (F.col("n") / F.col("all_words")).alias("q")))
    return classes, lists.join(lists.groupBy("lang", "fold").agg(F.sum("q").alias("all_q")), ["lang", "fold"])


def _part(p: Column, q: Column) -> Column:
    """What a bin of shares p and q adds to twice the divergence."""
    one = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return one(p, q) + one(q, p)


def class_distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of an array of counts to an array of shares."""
    terms = F.zip_with(counts, shares, lambda c, q: _part(c / total, q))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def word_distances(rows: DataFrame, lists: DataFrame, few: bool) -> DataFrame:
    """row, words_at: the Jensen-Shannon distance of a row's words to its list; bins that a row lacks add their share."""
    words = _counted(rows.where(~F.col("base_failed") & (F.col("n_words") >= ASKED_WORDS)), "row", "lang", "fold", "n_words")
    met = words.join(F.broadcast(lists) if few else lists, ["lang", "fold", "word"])
    share = F.col("n") / F.col("n_words")
    sums = met.groupBy("row").agg(F.sum(_part(share, F.col("q"))).alias("met"), F.sum(share).alias("p"), F.sum("q").alias("q"), F.max("all_q").alias("all_q"))
    rest = _part(F.greatest(F.lit(0.0), 1 - F.col("p")), F.greatest(F.lit(0.0), 1 - F.col("all_q")))
    return sums.select("row", F.sqrt(F.greatest(F.lit(0.0), (F.col("met") + F.col("all_q") - F.col("q") + rest) / 2)).alias("words_at"))


def word_limits(judged: DataFrame) -> DataFrame:
    """lang, size and the limit of the distances there; the lower half sets it: junk lies in the upper one.

    judged: lang, size, words_at. Quantiles are the steps in which the tenth part and the half of the rows are reached.
    """
    steps = judged.groupBy("lang", "size", F.floor(F.col("words_at") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("lang", "size")  # at most as many rows as steps
    steps = steps.withColumn("so_far", F.sum("n").over(own.orderBy("step"))).withColumn("total", F.sum("n").over(own))
    at = lambda part: F.min(F.when(F.col("so_far") >= part * F.col("total"), F.col("step")))
    seen = steps.groupBy("lang", "size").agg(at(0.1).alias("low"), at(0.5).alias("middle"), F.max("total").alias("n"))
    return seen.where(F.col("n") >= LEAST_DOCS).select("lang", "size", ((F.col("middle") + SPREADS * (F.col("middle") - F.col("low"))) / STEPS).alias("word_limit"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdicts(docs: DataFrame) -> DataFrame:
    """judge() with the keys text_key and lang of the rows."""
    rows = written(features(docs))
    few = rows.select("lang").distinct().limit(FEW_LANGS + 1).count() <= FEW_LANGS
    small = lambda df: F.broadcast(df) if few else df
    classes, lists = references(rows, few)
    judged = word_distances(rows, lists, few)
    size = F.least(F.length(F.bin(F.col("n_words").cast("bigint"))), F.lit(LONGEST_SIZE))
    rows = written(rows.drop("small", "times").join(judged, "row", "left").withColumn("size", size))
    limits = word_limits(rows.where("words_at IS NOT NULL").select("lang", "size", "words_at"))
    rows = rows.join(small(limits), ["lang", "size"], "left").join(small(classes), ["lang", "fold"], "left")
    strange_classes = F.coalesce((F.col("n_chars") >= LEAST_CHARS) & (class_distance(F.col("classes"), F.greatest(F.lit(1), F.col("n_chars")), F.col("ref_classes")) > CLASS_LIMIT), F.lit(False))
    strange_words = F.coalesce(F.col("words_at") > F.col("word_limit"), F.lit(False))
    return rows.select("doc_id", "text_key", "lang", *(F.col(c).cast("long").alias(c) for c in COUNTS), "base_failed", (~F.col("base_failed") & ~strange_classes & ~strange_words).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): the base counts, base_failed, kept."""
    return verdicts(docs).drop("text_key", "lang")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    own_id, own_key, own_lang = free_names(docs, "good_id", "good_key", "good_lang")
    kept = verdicts(docs).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key), F.col("lang").alias(own_lang))
    same = docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(own_key)) & (F.coalesce(docs["lang"], F.lit("")) == F.col(own_lang))
    return docs.join(kept, same, "left_semi")


def _sql() -> str:
    classes = [("space", r"[^\x20\x09-\x0D]+"), *((n, p.replace("'", "''").replace('\\"', '"')) for n, p in CLASSES)]
    hist = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g'))" for _, p in classes)
    sums = ", ".join(f"sum(classes[{i + 1}])" for i in range(len(CLASSES) + 2))
    one = lambda a, b: f"(CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END)"
    part = lambda p, q: f"({one(p, q)} + {one(q, p)})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 1))::INT % 2, 0) AS fold, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, [{hist}] AS h FROM d),
win AS (SELECT r, i, words[i:i+4] AS g FROM w, unnest(range(1, len(words) - 3)) u(i) WHERE len(words) >= 5),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, range(0, 5) s(j) GROUP BY r),
f AS (SELECT w.r, doc_id, lang, fold, length(t) AS n_chars, len(words) AS n_words, length(t) - h[1] AS word_chars, h[4] AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
             list_append(h, length(t) - list_sum(h)) AS classes, (len(words) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(words)) AS base_failed
      FROM w LEFT JOIN cov ON w.r = cov.r),
counted AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(list_transform(words, lambda x: lower(x))) AS word FROM w) GROUP BY r, word),
sums AS (SELECT lang, 1 - fold AS fold, sum(n_words) AS all_words, sum(n_chars) AS all_chars, [{sums}] AS c FROM f WHERE NOT base_failed GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
held AS (SELECT lang, 1 - fold AS fold, word, count(*) AS in_docs, sum(n) AS n FROM counted JOIN f USING (r) WHERE NOT base_failed GROUP BY ALL),
lists AS (SELECT lang, fold, word, n / all_words AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang, fold ORDER BY in_docs DESC, word) AS place FROM held) JOIN sums USING (lang, fold) WHERE place <= {COMMON}),
totals AS (SELECT lang, fold, sum(q) AS all_q FROM lists GROUP BY lang, fold),
terms AS (SELECT r, c.n / f.n_words AS p, l.q, t.all_q FROM counted c JOIN f USING (r) JOIN lists l USING (lang, fold, word) JOIN totals t USING (lang, fold) WHERE NOT base_failed AND n_words >= {ASKED_WORDS}),
met AS (SELECT r, sum({part('p', 'q')}) AS met, greatest(0, 1 - sum(p)) AS p, sum(q) AS q, max(all_q) AS all_q, greatest(0, 1 - max(all_q)) AS rest FROM terms GROUP BY r),
s AS (SELECT f.*, CASE WHEN met IS NOT NULL THEN sqrt(greatest(0, (met + all_q - q + {part('p', 'rest')}) / 2)) END AS words_at, least(length(bin(n_words)), {LONGEST_SIZE}) AS size FROM f LEFT JOIN met USING (r)),
steps AS (SELECT lang, size, floor(words_at * {STEPS}) AS step, count(*) AS n FROM s WHERE words_at IS NOT NULL GROUP BY ALL),
sofar AS (SELECT *, sum(n) OVER (PARTITION BY lang, size ORDER BY step) AS so_far, sum(n) OVER (PARTITION BY lang, size) AS total FROM steps),
limits AS (SELECT lang, size, (middle + {SPREADS} * (middle - low)) / {STEPS} AS word_limit FROM (SELECT lang, size, min(step) FILTER (so_far >= 0.1::DOUBLE * total) AS low, min(step) FILTER (so_far >= 0.5::DOUBLE * total) AS middle, max(total) AS n FROM sofar GROUP BY lang, size) WHERE n >= {LEAST_DOCS}),
j AS (SELECT s.*, limits.word_limit, sqrt(greatest(0, list_sum(list_transform(list_zip(classes, c), lambda z: {part('(z[1] / greatest(1, n_chars))', '(z[2] / all_chars)')})) / 2)) AS class_distance
      FROM s LEFT JOIN limits USING (lang, size) LEFT JOIN sums USING (lang, fold))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_chars >= {LEAST_CHARS} AND class_distance > {CLASS_LIMIT}, false) AND NOT coalesce(words_at > word_limit, false) AS kept
FROM j
"""


SQL = _sql()
