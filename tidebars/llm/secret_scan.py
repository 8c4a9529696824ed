"""Secret scans: assignment, access-key and hexadecimal patterns, and a randomness test battery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.llm.documents import ids_and_texts
from tidebars.llm.spans import let, match_spans
from tidebars.session import stage

# The patterns of the base kinds. Of the last two, runs too short are never
# kept and lie inside the only match there could be, so the least length is in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_VALUE = 6

TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_DISCOVERIES = 0.05
VETO = 0.001  # a token that fails a runs test or the serial test at this level is not random
BINS_PER_DECADE = 20
DECADES = 15
LENGTH_CLASSES = (20, 24, 32, 40, 48, 64, 96, 128, 256)  # least length of each
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = "+/_-"


@dataclass(frozen=True)
class Encoding:
    """An alphabet, the form of tokens written in it, and how uneven other tokens of that
    form are: their chi-squared distance from the even distribution, for each symbol."""

    form: str
    alphabet: str
    unevenness: float


ENCODINGS = (
    Encoding("^[0-9]+$", _DIGITS, 1.5),
    Encoding("^[0-9a-f]+$", "0123456789abcdef", 1.5),
    Encoding("^[0-9A-F]+$", "0123456789ABCDEF", 1.5),
    Encoding("^[A-Z2-7]+$", _UPPER + "234567", 1.1),
    Encoding("^[a-z]+$", _LOWER, 0.7),
    Encoding("^[a-z0-9]+$", _DIGITS + _LOWER, 1.4),
    Encoding("^[A-Z0-9]+$", _DIGITS + _UPPER, 1.4),
    Encoding("^[A-Za-z]+$", _UPPER + _LOWER, 2.4),
    Encoding("^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER, 3.1),
    Encoding("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 3.2),
    Encoding("^[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/_-", 3.5),
)


def lower_tail(z: Column) -> Column:
    """P(N(0,1) <= z) by a published polynomial for the tail (absolute error under 1e-7)."""

    def tail(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) * 0.3989422804014327 * poly

    return let(F.abs(z), lambda x: let(tail(x), lambda upper: F.when(z < 0, upper).otherwise(1 - upper)))


def class_changes(alphabet: str) -> tuple[float, float, float]:
    """Changes between lower case, upper case, digits and marks in random symbols: their
    mean for each pair of neighbours, the variance of one, and the covariance of two in a row."""
    shares = [sum(a in kind for a in alphabet) / len(alphabet) for kind in (_LOWER, _UPPER, _DIGITS, _MARKS)]
    mean = 1 - sum(p * p for p in shares)
    return mean, mean * (1 - mean), sum(p * (1 - p) ** 2 for p in shares) - mean * mean


def _class_z(token: Column, alphabet: str) -> Column:
    """How far the changes of class in a token fall short of those of random symbols.

    Words joined by marks or capitals change class at their ends only.
    """
    mean, variance, covariance = class_changes(alphabet)
    if variance < 1e-12:
        return F.lit(0.0)
    kinds = F.translate(token, _LOWER + _UPPER + _DIGITS + _MARKS, "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4)
    pairs = F.length(token).cast("double") - 1
    changes = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1
    return (pairs * mean - changes) / F.sqrt(pairs * variance + 2 * (pairs - 1) * covariance)


def _battery(symbols: Column, m: int, unevenness: float, class_z: Column) -> Column:
    """p-value of "not random" for places 0..m-1 of a token's symbols in its alphabet.

    The chi-squared statistic of an uneven source is about normal with mean m - 1 + L
    and variance 2 (m - 1 + 2 L), L growing with the length; p is the chance that such a
    source looks this even, so a short token is not called random for want of evidence.
    Runs about the middle of the alphabet, runs of one class of characters and the
    correlation of neighbours are tested against a random source; a token that fails one
    of them is given p = 1.
    """
    n = F.size(symbols).cast("double")
    counts = F.transform(F.array_distinct(symbols), lambda s: F.size(F.filter(symbols, lambda x: x == s)).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
    uneven = n * unevenness
    even_z = (squares * m / n - n - (m - 1) - uneven) / F.sqrt(2 * (m - 1 + 2 * uneven))

    high = F.size(F.filter(symbols, lambda s: s * 2 >= m)).cast("double")
    pairs = F.arrays_zip(F.slice(symbols, F.lit(1), F.size(symbols) - 1).alias("a"), F.slice(symbols, F.lit(2), F.size(symbols) - 1).alias("b"))
    runs = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= m) != (p["b"] * 2 >= m))).cast("double") + 1
    both = 2 * high * (n - high)
    spread = both * (both - n) / (n * n * (n - 1))
    runs_z = F.when(spread > 0, F.abs(runs - both / n - 1) / F.sqrt(spread)).otherwise(99.0)

    total = F.aggregate(symbols, F.lit(0.0), lambda a, s: a + s)
    power = F.aggregate(symbols, F.lit(0.0), lambda a, s: a + s.cast("double") * s) - total * total / n
    mean = total / n
    lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
    serial_z = F.when(power > 0, F.abs(lagged / power + 1 / n) * F.sqrt(n)).otherwise(99.0)

    normal = 2 * (1 - lower_tail(F.greatest(runs_z, serial_z, class_z)))
    return F.when(normal < VETO, F.lit(1.0)).otherwise(lower_tail(even_z))


def not_random(token: Column) -> Column:
    """p-value of a token (padding left out) under the first encoding whose form it has."""

    def under(e: Encoding) -> Column:
        places = F.transform(
            F.sequence(F.lit(1), F.length(token)), lambda i: F.instr(F.lit(e.alphabet), F.substring(token, i, F.lit(1))) - 1
        )
        return let(places, lambda symbols: _battery(symbols, len(e.alphabet), e.unevenness, _class_z(token, e.alphabet)))

    cases = F.when(F.length(token) < 2, F.lit(1.0))
    for e in ENCODINGS:
        cases = cases.when(token.rlike(e.form), under(e))
    return cases.otherwise(F.lit(1.0))


def stratum(token: Column) -> Column:
    """One number for a token's encoding and length class."""
    length, encoding = F.lit(0), F.lit(len(ENCODINGS))
    for i, least in enumerate(LENGTH_CLASSES):
        length = F.when(F.length(token) >= least, F.lit(i)).otherwise(length)
    for i, e in reversed(list(enumerate(ENCODINGS))):
        encoding = F.when(token.rlike(e.form), F.lit(i)).otherwise(encoding)
    return encoding * len(LENGTH_CLASSES) + length


def p_bin(p: Column) -> Column:
    """Bin of a p-value on a logarithmic scale; the bin stands for its upper end."""
    steps = F.floor(-F.log10(F.greatest(p, F.lit(10.0**-DECADES))) * BINS_PER_DECADE)
    return F.greatest(steps, F.lit(0)).cast("int")


def discovered_from(candidates: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``stratum, least_bin``: step-up false-discovery control in each stratum.

    Each p-value counts as its bin's upper end, which only makes the rule stricter. The
    counts are at most one row per stratum and bin, whatever the corpus.
    """
    counts = candidates.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    smaller = whole.orderBy(F.desc("bin"))
    ranked = counts.withColumns({"rank": F.sum("n").over(smaller), "all": F.sum("n").over(whole)})
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= F.col("rank") * rate / F.col("all"))
    return passed.groupBy("stratum").agg(F.min("bin").alias("least_bin"))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _span_text(spans: Column) -> Column:
    order = F.array_sort(spans)
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_spans, spans, n_random`` of every row.

    Base kinds are patterns; kind ``random`` are tokens of 20 and more characters that
    the battery finds random, with a share of false ones of ``rate`` at most among those
    of one encoding and length class, over all rows of the table. A token may be of a base kind as well:
    both spans are given. Spans are ``kind:start:end``, in code points, end exclusive, by
    start, then kind as in ``KINDS``.

    A missing text counts as empty; texts may be of any length. Repeated rows are
    scanned each, and each counts in the control. An empty table gives no rows; extra
    columns are ignored. Texts are read once and never shuffled: matches, without their
    texts, are written to the shared folder, and what has to be known of all of them is
    a table of at most strata x bins counts.
    """
    texts = ids_and_texts(docs)
    text = F.col("text")
    found = texts.select(
        "doc_id",
        match_spans(text, ASSIGN, 2).alias("assign"),
        match_spans(text, ACCESS).alias("access"),
        match_spans(text, HEX).alias("hex"),
        match_spans(text, TOKEN).alias("tokens"),
    )
    values = F.filter("assign", lambda s: F.length(s["group2"]) >= LEAST_VALUE)
    base = [_of_kind(spans, i).alias(KINDS[i]) for i, spans in enumerate((values, F.col("access"), F.col("hex")))]
    tokens = F.transform(
        F.col("tokens"),
        lambda t: let(
            F.rtrim(t["found"], F.lit("=")),
            lambda bare: F.struct(
                t["start"].alias("start"), t["end"].alias("end"),
                stratum(bare).alias("stratum"), p_bin(not_random(bare)).alias("bin"),
            ),
        ),
    )
    scanned = stage(found.select("doc_id", *base, tokens.alias("tokens")))
    limits = discovered_from(scanned.select(F.explode("tokens").alias("t")).select("t.stratum", "t.bin"), rate)
    # one row at most: an array of as many limits as there are strata
    least = limits.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least_bin"))).alias("least"))
    judged = scanned.join(F.broadcast(least))
    random = F.filter("tokens", lambda t: t["bin"] >= F.try_element_at(F.col("least"), t["stratum"]))
    return judged.select("doc_id", "assign", "access", "hex", _of_kind(random, 3).alias("random")).select(
        "doc_id",
        *[F.size(name).cast("long").alias(f"n_{name}") for name in KINDS],
        _span_text(F.concat("assign", "access", "hex")).alias("base_spans"),
        _span_text(F.concat("assign", "access", "hex", "random")).alias("spans"),
    )
