"""Secret scan with DataFrame functions alone: fixed patterns, and character Markov models.

Patterns (leftmost, non-overlapping per kind, matches that fail the length are dropped):
assign ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, key words in either
case, group 2 of 12 or more characters; access ``AKIA[A-Z0-9]+`` of 18 or more; hex ``[0-9a-f]+`` of 16 or more.

The method adds spans of kind markov: runs of 20 or more key-like characters, or what the patterns leave of
them in pieces of 20 or more, whose log-likelihood under
a character bigram model of random strings exceeds that under a model of ordinary identifiers.  Of other runs, the stretches
that do so by themselves are marked, so that what stands beside a key doesn't outweigh it.  Both
models are counted from labelled strings: values of pattern matches and seeded random strings on one
side, ordinary words of the documents and a list of identifiers on the other.  The documents for that
are a bounded sample (``train_docs``), all with small hashes of their id; scanning reads every text.

Positions are code points, end exclusive.  Null texts count as empty; an empty text has no spans; equal
texts have equal spans; repeated rows return a row each; an empty table gives no rows, and models from
the fixed samples alone; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, id_and_text

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# For these two, a run that is too short fails at each of its suffixes too, so the length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Words of ordinary shape: lower case, first letters large, parts joined by signs or large letters.
# The repeated group is possessive: Java matches it in a loop then, and by recursion otherwise, which long names end.
WORD = r"\b[A-Za-z][a-z]{2,}+(?:[_/-][a-z]{2,}+|[A-Z][a-z]{2,}+)*+\b"

TRAIN_DOCS = 2000
RANDOM_STRINGS = 1500
#: Natural-log odds a candidate must exceed.
MARGIN = 10.0
#: Characters of a stretch within a run, at least.
STRETCH = 16

#: Ordinary identifiers, labelled 0: words of common programs and addresses.
IDENTIFIERS = """
application_configuration authenticationProvider background_worker_process calculateTotalAmount
connection_pool_timeout createUserAccount customer_relationship_manager databaseConnectionString
default_notification_settings documentation/getting-started/installation environment-variables-overview
extractNumericTokens findAllByCreatedDate generate_monthly_report getElementById handleIncomingRequest
https://www.example.org/articles/introduction/overview initializeComponentState internationalization
java/util/concurrent/ThreadPoolExecutor loadUserPreferences maximum_retry_attempts
normalize_business_address notification_service_endpoint organizationalUnitName parse_command_line_arguments
performance-monitoring-dashboard postgresql_replication_slot process_payment_transaction
queryParameterBuilder register_event_listener responsibilities src/main/resources/templates/index
synchronizeRemoteRepository test_integration_between_modules transaction_isolation_level
unauthorized_access_exception updateShoppingCartTotal user_interface_component validateInputParameters
var/log/application/server virtualMachineConfiguration website-navigation-menu-items worker_thread_counter
----------------------------------------------- ================================================ ________________________
""".split()


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once."""
    return F.transform(F.array(x), f)[0]


def running(values: Column, join) -> Column:
    """Running results of an associative ``join`` over an array, by steps of doubling width: n log n."""

    def widen(so_far: Column, k: Column) -> Column:
        return F.transform(so_far, lambda x, i: F.when(i >= k, join(x, F.get(so_far, i - k))).otherwise(x))

    widths = F.array(*(F.lit(1 << b) for b in range(31)))
    return _let(values, lambda v: F.aggregate(F.filter(widths, lambda k: k < F.size(v)), v, widen))


def matches(text: Column, pattern: str, group: int, least: int, kind: int, value: bool = False) -> Column:
    """Spans (start, end, kind) of a pattern's matches whose group has ``least`` characters; null: none at all.

    split() gives what lies between matches, so running lengths give positions in code points.  With ``value``
    a span has the group's text too.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(hits: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        return _let(F.arrays_zip(between.alias("gap"), hits.alias("hit"), values.alias("value")), placed)

    def placed(steps: Column) -> Column:
        ends = running(F.transform(steps, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, b: a + b)
        return _let(ends, lambda at: F.transform(F.filter(F.transform(steps, lambda x, i: F.struct(x.alias("x"), F.get(at, i).alias("end"))), lambda x: F.length(x["x"]["value"]) >= least), span))

    def span(x: Column) -> Column:
        found = [(x["end"] - F.length(x["x"]["hit"])).alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")]
        return F.struct(*found, *[x["x"]["value"].alias("value")] * value)

    return F.when(text.rlike(pattern), _let(whole, spans))


def rewritten(text: Column, spans: Column, fill) -> Column:
    """The text with spans, sorted by start, replaced: fill(span, where the text before it was left) gives what stands
    for a span.  Linear in the text."""
    reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def built(chars: Column, ends: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            return _let(F.coalesce(F.get(ends, i - 1), F.lit(0)), lambda at: F.concat(F.array_join(F.slice(chars, at + 1, F.greatest(s["start"] - at, F.lit(0))), ""), fill(s, at)))

        rest = F.slice(chars, F.element_at(ends, -1) + 1, F.size(chars))
        return F.concat(F.array_join(F.transform(spans, part), ""), F.array_join(rest, ""))

    whole = _let(F.split(text, ""), lambda chars: _let(reach, lambda ends: built(chars, ends)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def base_spans(text: Column) -> list[Column]:
    """Spans of each fixed kind, in order of kind; null where there is none."""
    return [matches(text, ASSIGN, 2, 12, 0), matches(text, ACCESS, 0, 18, 1), matches(text, HEX, 0, 16, 2)]


def labelled_strings(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(value, label): 1 for random strings, 0 for ordinary words; from documents (doc_id, text)."""
    spark = docs.sparkSession
    rank = F.xxhash64("doc_id", "text", F.lit(11))  # with the text, as ids may all be null or equal
    last = docs.select(rank.alias("rank")).orderBy("rank").limit(train_docs).agg(F.max("rank")).first()[0]
    sample = docs.where(rank <= (last if last is not None else 0)).select("text")
    values = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    seeded = spark.range(RANDOM_STRINGS).select(F.substring(F.base64(F.unhex(F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")), 256))), 1, 40).alias("value"), F.lit(1).alias("label"))
    fixed = spark.range(40).select(F.explode(F.lit(IDENTIFIERS)).alias("value"), F.lit(0).alias("label"))
    return (
        sample.select(F.explode(values).alias("value"), F.lit(1).alias("label"))
        .unionByName(sample.select(F.explode(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0))).alias("value"), F.lit(0).alias("label")))
        .unionByName(seeded)
        .unionByName(fixed)
    )


def train(strings: DataFrame, smoothing: float = 20.0) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each pair of ASCII characters: 128 * 128 values."""
    pairs = _let(F.split("value", ""), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c)), lambda a, b: F.concat(a, b)))
    low = strings.select("label", pairs.alias("pairs"))
    counts = low.select("label", F.explode("pairs").alias("pair")).groupBy("label", "pair").count().collect()  # 2 * 128 * 128 rows at most
    pair: list[dict] = [{}, {}]
    before: list[dict] = [{}, {}]
    after: list[dict] = [{}, {}]
    for r in counts:
        pair[r.label][r.pair] = r["count"]
        for into, c in ((before, r.pair[0]), (after, r.pair[1])):
            into[r.label][c] = into[r.label].get(c, 0) + r["count"]
    size = [sum(x.values()) for x in after]

    def chance(k: int, a: str, b: str) -> float:
        """P(b | a) of class k, drawn towards P(b) where a is rare."""
        alone = (after[k].get(b, 0) + 0.5) / (size[k] + 0.5 * 66)
        return (pair[k].get(a + b, 0) + smoothing * alone) / (before[k].get(a, 0) + smoothing)

    letters = [chr(i) for i in range(128)]
    return [round(math.log(chance(1, a, b) / chance(0, a, b)), 4) for a in letters for b in letters]


def log_ratio(value: Column, table: list[float]) -> Column:
    """Summed log-likelihood ratio of a string of ASCII characters; linear in its length."""
    ratios = F.lit(table)

    def total(codes: Column) -> Column:
        steps = F.transform(F.slice(codes, F.lit(2), F.size(codes)), lambda b, i: F.get(ratios, F.get(codes, i) * 128 + b))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)

    return _let(F.transform(F.split(value, ""), lambda c: F.ascii(c)), total)


def stretches(value: Column, table: list[float], margin: float) -> Column:
    """Spans (start, end) within a string of ASCII characters that are likelier random than ordinary, whatever stands
    beside them.

    The running sum of log-likelihood ratios starts anew wherever it falls to its lowest so far; each such start has its
    highest sum after it.  Where this exceeds the margin over ``STRETCH`` characters or more, the stretch between is
    marked, widened to the letters and digits that it is part of.
    """
    ratios, whole = F.lit([round(x * 10_000) for x in table]), F.lit(round(margin * 10_000))
    number = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))

    def scored(codes: Column) -> Column:
        steps = F.transform(codes, lambda b, i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(ratios, F.get(codes, i - 1) * 128 + b).cast("long")))
        return _let(steps, lambda steps: F.when(highest(steps) > whole, _let(running(steps, lambda a, b: a + b), lambda sums: found(codes, sums))))

    def highest(steps: Column) -> Column:
        zero = F.lit(0).cast("long")
        state = F.struct(zero.alias("s"), zero.alias("top"))
        add = lambda a, x: _let(F.greatest(a["s"] + x, zero), lambda s: F.struct(s.alias("s"), F.greatest(a["top"], s).alias("top")))
        return F.aggregate(steps, state, add)["top"]

    def found(codes: Column, sums: Column) -> Column:
        lows = running(F.transform(sums, lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))), F.least)
        gains = _let(lows, lambda lows: F.transform(sums, lambda p, j: F.struct((-F.get(lows, j)["i"]).alias("a"), (p - F.get(lows, j)["p"]).alias("s"), (-j).alias("j"))))
        best = running(gains, lambda x, y: F.when(x["a"] == y["a"], F.greatest(x, y)).otherwise(x))
        last = lambda best: F.filter(best, lambda x, i: F.coalesce(F.get(best, i + 1)["a"] != x["a"], F.lit(True)))
        peaks = F.filter(_let(best, last), lambda x: (x["s"] > whole) & (-x["j"] - x["a"] + 1 >= STRETCH))
        letter = lambda c: c.between(48, 57) | c.between(65, 90) | c.between(97, 122)
        n = F.size(codes)
        before = running(F.transform(codes, lambda c, i: F.when(letter(c), F.lit(-1)).otherwise(i)), F.greatest)
        after = F.reverse(running(F.reverse(F.transform(codes, lambda c, i: F.when(letter(c), n).otherwise(i))), F.least))
        widened = lambda lo, hi: F.transform(peaks, lambda x: F.struct((F.get(lo, x["a"]) + 1).alias("start"), F.get(hi, -x["j"]).alias("end")))
        return _let(before, lambda lo: _let(after, lambda hi: F.array_distinct(widened(lo, hi))))

    none = F.filter(F.array(number), lambda _: F.lit(False))
    return F.coalesce(_let(F.transform(F.split(value, ""), lambda c: F.ascii(c)), scored), none)


def with_spans(docs: DataFrame, text: str, table: list[float], margin: float = MARGIN, names: tuple[str, str] = ("base", "spans")) -> DataFrame:
    """docs with two columns more: arrays of (start, end, kind) sorted by start, then kind, of a column of texts.

    What base spans cover is blanked, so that the candidates are the runs, or pieces of runs, that they leave.
    """
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    held = docs.withColumn(names[0], F.array_sort(F.concat(*(F.coalesce(p, none) for p in base_spans(F.col(text))))))
    bare, runs = free_name(held, "__bare"), free_name(held, "__runs")
    blank = lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0)))
    held = held.withColumn(bare, rewritten(F.col(text), F.col(names[0]), blank))
    held = held.withColumn(runs, matches(F.col(bare), CANDIDATE, 0, 20, 3, value=True))
    span = lambda r, start, end: F.struct(start.alias("start"), end.alias("end"), r["kind"].alias("kind"))
    parts = lambda r: F.transform(stretches(r["value"], table, margin), lambda x: span(r, r["start"] + x["start"], r["start"] + x["end"]))
    likely = F.flatten(F.transform(F.col(runs), lambda r: F.when(log_ratio(r["value"], table) > margin, F.array(span(r, r["start"], r["end"]))).otherwise(parts(r))))
    return held.withColumn(names[1], F.array_sort(F.concat(F.col(names[0]), F.coalesce(likely, none)))).drop(bare, runs)


def scan(docs: DataFrame, table: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, text, base and spans: arrays of (start, end, kind) sorted by start, then kind.

    base holds the fixed kinds; spans adds the markov spans, which leave out what fixed spans cover.
    """
    base = id_and_text(docs, id_col, text_col)
    table = table if table is not None else train(labelled_strings(base, train_docs))
    return with_spans(base, "text", table, margin)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with its spans (sorted by start), joined where they overlap, each replaced by a mark."""
    return rewritten(text, spans, lambda s, at: F.when(s["start"] >= at, F.lit(mark)).otherwise(F.lit("")))
