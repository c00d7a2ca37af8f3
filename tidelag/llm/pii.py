"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns give seed entities. Identifier-shaped strings and the two words in front of them
form a graph of patterns and instances; both are scored in turns, starting from the seeds, and
strings behind patterns of high confidence are found as further identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm.common import read_table, staged

# The base patterns. Each is written so that Java's matcher needs linear time and
# no recursion: quantifiers are possessive where that changes no match, and a match starts only
# where a run starts or the previous match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Identifier-shaped: at least six letters, digits, - or _, one of them a digit.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{6,}+"
#: Seeds besides the base entities: digests as they stand in credentials.
DIGEST = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"
#: Characters of a pattern: two whole words in front that need more than this are none.
CONTEXT_CHARS = 128
#: Values of a running sum, and code points of a text, that are walked through at once.
BLOCK, PIECE = 128, 256
ROUNDS = 3
CONFIDENCE = 0.7
SUPPORT = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, levels: int = 2) -> Column:
    """array<int>: for each value the sum of those before it; blocks of blocks, so that the cost stays near linear."""
    none = F.array().cast("array<int>")
    each = lambda block, start: F.aggregate(
        block, F.struct(start.alias("at"), none.alias("found")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["found"], F.array(acc["at"])).alias("found")), lambda acc: acc["found"],
    )
    if not levels:
        return each(values, F.lit(0))
    cut = lambda v: F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))).otherwise(F.array().cast("array<array<int>>"))
    sums = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    joined = lambda blocks: let(running(sums(blocks), levels - 1), lambda at: F.flatten(F.transform(blocks, lambda b, i: each(b, F.get(at, i)))))
    return let(values, lambda v: let(cut(v), joined))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of leftmost matches that do not overlap, in code points.

    What stands between matches and the matches themselves alternate, so their running lengths
    give the places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = lambda p: F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["value"]))
    place = lambda x: F.struct(
        (x["before"] + F.length(x["p"]["gap"])).alias("start"), (x["before"] + F.length(x["p"]["gap"]) + F.length(x["p"]["value"])).alias("end"), x["p"]["value"].alias("value")
    )
    pairs = let(values, lambda v: F.arrays_zip(F.slice(gaps, 1, F.size(v)).alias("gap"), v.alias("value")))
    return let(pairs, lambda p: F.transform(F.arrays_zip(p.alias("p"), running(sizes(p)).alias("before")), place))


def adds_before(adds: Column, queries: Column, strictly: bool) -> Column:
    """array<int>: for each of the ascending queries how many of ``adds`` are smaller (or as large, unless ``strictly``)."""
    one, zero = F.lit(1), F.lit(0)
    event = lambda turn, add: lambda x: F.struct(x.alias("at"), turn.alias("turn"), add.alias("add"))
    both = F.array_sort(F.concat(F.transform(adds, event(one if strictly else zero, one)), F.transform(queries, event(zero if strictly else one, zero))))
    counted = lambda e: F.arrays_zip(e.alias("e"), running(F.transform(e, lambda x: x["add"])).alias("n"))
    return let(both, lambda e: F.transform(F.filter(counted(e), lambda z: z["e"]["add"] == 0), lambda z: z["n"]))


def touched(spans: Column, base: Column) -> Column:
    """array<boolean>: whether each of the spans, in order and apart, overlaps one of ``base``."""
    part = lambda x, c: F.transform(x, lambda s: s[c])
    begun, over = adds_before(part(base, "start"), part(spans, "end"), True), adds_before(part(base, "end"), part(spans, "start"), False)
    return F.zip_with(begun, over, lambda a, b: a > b)


def pieces_of(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points, from which any part is taken without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def part_of(pieces: Column, start: Column, length: Column) -> Column:
    whole = F.array_join(F.slice(pieces, F.floor(start / PIECE).cast("int") + 1, F.floor(length / PIECE).cast("int") + 2), "")
    return F.substring(whole, start % PIECE + 1, length)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's check."""
    figures = F.transform(F.split(F.reverse(digits(value)), ""), lambda c: c.cast("int"))
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    terms = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).otherwise(double(d)))
    return F.aggregate(terms, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.when(F.length(part(p)) <= 3, part(p)).otherwise("999").cast("int") <= 255))
    if kind == "card":
        n = F.length(digits(value))
        return n.between(16, 19) & F.when(n.between(16, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """By kind the base spans; texts without a sign that the kind needs are not searched."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][ -]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
    checked = lambda kind: lambda x: valid(kind, x["value"])
    return {k: F.when(needs[k], F.filter(located(text, patterns[k]), checked(k))).otherwise(none) for k in KINDS}


def extract(docs: DataFrame, kept: Column) -> DataFrame:
    """row, doc_id, ``kept``, base spans by kind, and candidates (start, end, value, context, seed)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), kept.alias("kept"), text.alias("text"))
    rows = rows.select("*", *(c.alias(k) for k, c in base_spans(F.col("text")).items()))
    whole = F.concat(*KINDS)
    before = lambda p, x: part_of(p, F.greatest(F.lit(0), x["start"] - CONTEXT_CHARS), F.least(x["start"], F.lit(CONTEXT_CHARS)))
    # the first word is whole: white space stands before it, or the text starts with it
    words = lambda b, x: F.when(x["start"] <= CONTEXT_CHARS, F.regexp_extract(b, r"(?<!\S)\S+\s+\S*\s*$", 0)).otherwise(F.regexp_extract(b, r"(?<=\s)\S+\s+\S*\s*$", 0))
    context = lambda p, x: F.regexp_replace(F.lower(let(before(p, x), lambda b: words(b, x))), "[0-9]+", "#")
    candidate = lambda p: lambda x, hit: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["value"]).alias("value"), context(p, x).alias("context"),
        (x["value"].rlike(DIGEST) | hit).alias("seed"), hit.alias("touches"),
    )
    found = lambda p: let(located(F.col("text"), CANDIDATE), lambda c: F.zip_with(c, touched(c, whole), candidate(p)))
    candidates = let(pieces_of(F.col("text")), found)
    none = F.array().cast("array<struct<start:int,end:int,value:bigint,context:string,seed:boolean,touches:boolean>>")
    return rows.select("row", "doc_id", "kept", *KINDS, F.when(F.col("text").rlike("[0-9]"), candidates).otherwise(none).alias("candidates"))


def confident_contexts(candidates: DataFrame) -> DataFrame:
    """Contexts that identifiers stand behind, scored with their instances in turns.

    A context's score is the mean score of its distinct instances with one doubtful instance
    added; an instance has 1 if it is a seed, else the probability that one of its contexts is right.
    """
    graph = staged(candidates.where("context <> ''").groupBy("context", "value").agg(F.max("seed").alias("seed")), "pii-graph")
    instances = graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for turn in range(ROUNDS):
        contexts = graph.join(instances, "value").groupBy("context").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count("*").alias("support"))
        contexts = staged(contexts, "pii-contexts")
        if turn < ROUNDS - 1:
            doubt = F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))))
            instances = staged(
                graph.join(contexts, "context").groupBy("value")
                .agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("score")), "pii-instances",
            )
    return contexts.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("context")


def find(docs: DataFrame, kept: Column | None = None) -> DataFrame:
    """doc_id, base spans by kind, and ``further``: spans found by context that touch no base span;
    and, for callers that need more of a row than its spans, ``kept``.

    Null and empty texts have none; repeated rows and rows without doc_id are treated each; an
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    table = staged(extract(docs, F.lit(True) if kept is None else kept), "pii-spans")
    single = table.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    contexts = confident_contexts(single)
    open_ = F.filter("candidates", lambda x: ~x["touches"])
    free = table.select("row", F.explode(open_).alias("c")).select("row", "c.start", "c.end", "c.context")
    found = free.join(contexts, "context", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("further"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return table.drop("candidates").join(found, "row", "left").withColumn("further", F.coalesce("further", none))


def as_text(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))


def merged(spans: Column) -> Column:
    """array<struct<start, end, kind>>: sorted spans, those that overlap as one of the first one's kind."""
    opens = lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("step"), x["end"].alias("end"), x["kind"].alias("kind"))
    closes = lambda x: F.struct(x["end"].alias("at"), F.lit(-1).alias("step"), x["end"].alias("end"), x["kind"].alias("kind"))
    steps = F.array_sort(F.concat(F.transform(spans, opens), F.transform(spans, closes)))
    depths = lambda e: F.arrays_zip(e.alias("e"), running(F.transform(e, lambda x: x["step"])).alias("depth"))
    first = lambda z: F.filter(z, lambda x: (x["e"]["step"] == 1) & (x["depth"] == 0))
    last = lambda z: F.filter(z, lambda x: (x["e"]["step"] == -1) & (x["depth"] == 1))
    return let(let(steps, depths), lambda z: F.zip_with(first(z), last(z), lambda a, b: F.struct(a["e"]["at"].alias("start"), b["e"]["at"].alias("end"), a["e"]["kind"].alias("kind"))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; spans that overlap become one.

    Null texts stay null; rows without personal data, repeated rows and rows without doc_id stay;
    ``n_chars`` is counted anew; an empty table gives no rows.
    """
    of_kind = lambda kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    # whole rows are kept beside their spans, so that only the few spans found by context are joined to them
    joined = find(docs, F.struct("*")).select("kept", F.col("kept.text").cast("string").alias("text"), F.concat(*(F.transform(k, of_kind(k)) for k in (*KINDS, "further"))).alias("_spans"))
    label = lambda x: F.concat(F.lit("<"), F.upper(F.when(x["kind"] == "further", "id").otherwise(x["kind"])), F.lit(">"))
    end_before = lambda m, i: F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)
    shown = lambda p, m: F.concat(
        F.array_join(F.transform(m, lambda x, i: F.concat(part_of(p, end_before(m, i), x["start"] - end_before(m, i)), label(x))), ""),
        let(F.get(m, F.size(m) - 1)["end"], lambda end: part_of(p, end, F.length(F.col("text")) - end)),
    )
    replaced = let(pieces_of(F.col("text")), lambda p: let(merged(F.col("_spans")), lambda m: shown(p, m)))
    changed = joined.select("kept", F.when(F.size("_spans") == 0, F.col("text")).otherwise(replaced).alias("text"))
    columns = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col("kept").getField(c).alias(c) for c in docs.columns]
    return changed.select(*columns)


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read_table(spark, sf_dir, "documents"))
    base = F.concat(*(as_text(F.col(k), k) for k in KINDS))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, as_text(F.col("further"), "id")), ",").alias("spans"),
    )
