"""Secret scan: known shapes of secrets, and runs of characters whose entropy is that of random strings.

Three patterns give the base spans. Beside them, every maximal run of a character class (hexadecimal, Base64) of at
least `WINDOW` characters is a candidate. A window of that length slides over it with the counts of its characters: the
one that enters and the one that leaves change two counts and the sum of c*log2(c), in whole numbers of 2**-20, so sums
are exact. Windows at or above the class's entropy are secret; those that touch join to one span.

The allow list works on parts and windows, never on whole runs: what it names (examples, alphabets, UUIDs) ends a run
and is left out, the rest goes on; windows of digits alone, of letters of one case, or of a word with one capital are
no secrets. Long runs are cut in blocks, each with the window before it, and summed block by block; spans that touch at
a block's end join afterwards.

Results for odd input: a null text counts as an empty one, without spans; rows that share an id get one row each;
further columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapsync.llm.common import written

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A cheap sign that ASSIGN can match at all.
ASSIGN_HINT = r"""(?i:passw|secret|token|api_?key)"""
#: The greedy run is whole either way, so a minimum length in the pattern equals dropping short runs later.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"

WINDOW = 24
#: Window ends that are looked at together.
BLOCK = 512
#: Parts of a run that are no secrets.
ALLOWED = r"(?i:example)|(?i:abcdefg)|0123456789|(?<![0-9A-Za-z])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9A-Za-z])"
#: Character classes: kind, the characters of a run, least bits a character.
CLASSES = (("hexrun", "0-9A-Fa-f", 3.0), ("base64", "A-Za-z0-9+/_=-", 3.9))
#: Characters by their numbers from 1 on: 10 digits, 26 small letters, 26 capitals, others.
NUMBERED = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
SCALE = 1 << 20
#: round(c * log2(c) * SCALE) for c = 0 .. WINDOW.
C_LOG_C = [0, *(round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1))]


def most_sum(bits: float) -> int:
    """Entropy >= bits in a window means that the sum of c*log2(c) is at most this."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def _places(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (start, end, match) of all matches; texts without the hint are not searched."""
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = lambda a: F.transform(a, F.length)
    pairs = F.arrays_zip(lengths(pieces).alias("gap"), lengths(matches).alias("len"), matches.alias("match"))
    step = lambda s, x: F.struct(
        (s["at"] + x["gap"] + x["len"]).alias("at"),
        F.concat(s["all"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["len"]).alias("end"), x["match"].alias("match")))).alias("all"),
    )
    kind = "array<struct<start:int,end:int,match:string>>"
    found = F.aggregate(F.filter(pairs, lambda x: x["match"].isNotNull()), F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("all")), step, lambda s: s["all"])
    return F.when(hint, found).otherwise(F.array().cast(kind))


def _spans(places: Column, kind: str, rank: int) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def _runs(text: Column, kind: str, members: str, bits: float) -> Column:
    # What the allow list names is a match of its own, and thrown away.
    pattern = f"(?:{ALLOWED})|(?:(?!{ALLOWED})[{members}]){{{WINDOW},}}"
    found = F.filter(_places(text, pattern, text.rlike(f"[{members}]{{{WINDOW}}}")), lambda x: ~x["match"].rlike(f"^(?:{ALLOWED})$"))
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["match"].alias("match"), F.lit(most_sum(bits)).alias("most")))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _secret_ends(piece: Column, most: Column) -> Column:
    """Places (from 0) of piece where secret windows end."""
    table = F.array(*map(F.lit, C_LOG_C))
    f = lambda n: F.get(table, n)
    one = lambda condition: F.when(condition, 1).otherwise(0)
    numbers = F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: F.instr(F.lit(NUMBERED), c))
    steps = lambda n: F.transform(n, lambda c, i: F.struct(i.alias("i"), c.alias("in"), F.coalesce(F.get(n, i - WINDOW), F.lit(0)).alias("out")))
    kinds = {"digits": (1, 10), "small": (11, 36), "capitals": (37, 62)}

    def moved(s: Column, x: Column) -> Column:
        same = x["in"] == x["out"]
        held, left = F.get(s["counts"], x["in"]) - one(same), F.get(s["counts"], x["out"])
        gain = f(held + 1) - f(held) - F.when(x["out"] > 0, f(left) - f(left - 1)).otherwise(0)
        counts = F.transform(s["counts"], lambda c, k: c + one(k == x["in"]) - one((k == x["out"]) & (k > 0)))
        change = lambda a, b: one(x["in"].between(a, b)) - one(x["out"].between(a, b))
        return F.struct(counts.alias("counts"), (s["sum"] + gain).cast("bigint").alias("sum"), *((s[k] + change(*of)).cast("int").alias(k) for k, of in kinds.items()))

    def step(s: Column, x: Column) -> Column:
        def judged(new: Column) -> Column:
            letters = new["small"] + new["capitals"]
            plain = (new["digits"] == WINDOW) | ((letters == WINDOW) & ((new["capitals"] <= 1) | (new["small"] == 0))) | (letters + new["digits"] == 0)
            secret = (x["i"] >= WINDOW - 1) & (new["sum"] <= most) & ~plain
            return F.struct(*(new[k].alias(k) for k in ("counts", "sum", *kinds)), F.when(secret, F.array_append(s["ends"], x["i"])).otherwise(s["ends"]).alias("ends"))

        return _let(moved(s, x), judged)

    start = F.struct(F.array_repeat(F.lit(0), len(NUMBERED) + 1).alias("counts"), F.lit(0).cast("bigint").alias("sum"), *(F.lit(0).alias(k) for k in kinds), F.array().cast("array<int>").alias("ends"))
    return _let(numbers, lambda n: F.aggregate(steps(n), start, step, lambda s: s["ends"]))


def _merged(spans: Column) -> Column:
    """Sorted spans (start, end), with those that touch joined."""
    kind = "array<struct<start:int,end:int>>"
    last = lambda s: F.element_at(s, -1)
    longer = lambda s, x: F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last(s)["start"].alias("start"), F.greatest(last(s)["end"], x["end"]).alias("end"))))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), lambda s, x: F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["end"] >= x["start"]), longer(s, x)).otherwise(F.concat(s, F.array(x))))


def entropy_spans(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end of the joined secret windows of each candidate (keys, kind, start, match, most)."""
    own = [*keys, "kind", "start"]
    # A run is cut once, from its beginning to its end; each block brings the window before it along, but for that
    # window's first character, and no row holds more than that.
    cut = F.regexp_extract_all("match", F.lit(f".{{1,{BLOCK}}}"), F.lit(0))
    lead = lambda pieces, i: F.when(i > 0, F.right(F.get(pieces, i - 1), F.lit(WINDOW - 1))).otherwise("")
    led = _let(cut, lambda pieces: F.transform(pieces, lambda p, i: F.struct(lead(pieces, i).alias("lead"), p.alias("own"))))
    blocks = candidates.select(*own, "most", F.posexplode(led).alias("block", "cut"))
    blocks = blocks.select(*own, "most", "block", F.length("cut.lead").alias("lead"), F.concat("cut.lead", "cut.own").alias("piece")).repartition(*own, "block")
    base = F.col("start") + (F.col("block") * BLOCK - F.col("lead")).cast("int")
    windows = F.transform(_secret_ends(F.col("piece"), F.col("most")), lambda i: F.struct((base + i - WINDOW + 1).cast("int").alias("start"), (base + i + 1).cast("int").alias("end")))
    found = blocks.select(*own, _merged(windows).alias("spans")).where(F.size("spans") > 0)
    joined = found.groupBy(*own).agg(F.flatten(F.collect_list("spans")).alias("spans")).select(*keys, F.inline(_merged(F.col("spans"))))
    return joined.select(*keys, "start", "end")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs (columns doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    t = F.col("text")
    assign = F.filter(_places(t, ASSIGN, t.rlike(ASSIGN_HINT)), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= 12)
    access, hexes = _places(t, ACCESS, t.contains("AKIA")), _places(t, HEX, t.rlike(HEX))
    runs = [_runs(t, *of) for of in CLASSES]
    spans = F.concat(*(_spans(x, k, i) for i, (k, x) in enumerate(zip(KINDS, (assign, access, hexes)))))
    found = written(docs.select("doc_id", "text_key", F.size(assign).cast("long").alias("n_assign"), F.size(access).cast("long").alias("n_access"), F.size(hexes).cast("long").alias("n_hex"), spans.alias("base"), F.concat(*runs).alias("runs")))
    candidates = found.where(F.size("runs") > 0).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.inline("runs"))
    more = entropy_spans(candidates, ["doc_id", "text_key"]).distinct().groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("entropy").alias("kind"))).alias("more"))
    more = more.select(F.col("doc_id").alias("other_id"), F.col("text_key").alias("other_key"), "more")
    both = found.join(more, (F.col("text_key") == F.col("other_key")) & F.col("doc_id").eqNullSafe(F.col("other_id")), "left")
    # A base span that holds all of it says more than an entropy span.
    new = F.filter(F.col("more"), lambda m: ~F.exists("base", lambda b: (b["start"] <= m["start"]) & (b["end"] >= m["end"])))
    all_spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", new))
    return both.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(all_spans).alias("spans"))
