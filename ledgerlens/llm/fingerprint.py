"""Document fingerprints: one-permutation MinHash in packed low-order bits, DataFrame functions only.

The words of a text (between ASCII white space, A-Z lower-cased) give runs of five words, a
shorter text one run of all. Each run is hashed once; the top bits of the hash choose one of ``BINS`` bins,
and every bin keeps the smallest hash. An empty bin asks other bins in a pseudo-random order of
its own, the same for all texts, and takes the value of the first that is filled (optimal
densification); after ``ASKS`` questions it asks all filled bins at once and takes the one of the smallest
hash of both numbers. The lowest ``BITS`` bits of all bins, packed, are the fingerprint.

Two different values agree in b bits by chance with 2**-b, which the likeness corrects:
(share of equal bins - 2**-b) / (1 - 2**-b), at least 0.

A text without words has the empty fingerprint; its likeness to another text without words is 1,
to any other text 0. Null texts count as empty. Texts are read whole, one row at a time, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
BINS = 128
BITS = 8
#: Questions an empty bin asks one by one.
ASKS = 6
#: Rows between two boundaries of the order by id, about; more where there would be over MOST_RUNS runs.
RUN = 2_000
MOST_RUNS = 10_000

SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of words of a text; empty without words."""
    parts = F.filter(F.split(F.translate(text, UPPER, LOWER), SPACES), lambda w: w != "")

    def runs(h: Column) -> Column:
        n = F.size(h)
        whole = F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " ")))
        each = F.transform(F.slice(h, 1, F.greatest(n - (words - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < words, whole).otherwise(each)

    return let(F.transform(parts, lambda w: F.xxhash64(w)), runs)


def bins_of(hashes: Column, bins: int = BINS) -> Column:
    """The smallest hash of each bin, null where the bin is empty: array<bigint> of ``bins``."""
    shift = 64 - (bins - 1).bit_length()
    number = lambda x: F.shiftrightunsigned(x, shift).cast("int")

    def dealt(ordered: Column) -> Column:
        # in order each bin's hashes stand together, the smallest first
        heads = F.filter(ordered, lambda x, i: (i == 0) | (number(x) != number(F.get(ordered, F.greatest(i - 1, F.lit(0))))))
        return let(F.map_from_arrays(F.transform(heads, number), heads), lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.try_element_at(m, b)))

    return let(F.array_sort(hashes), dealt)


def densified(values: Column, bins: int = BINS) -> Column:
    """The bins with every empty one filled from another; null if all are empty."""

    def filled(v: Column) -> Column:
        def ask(now: Column, k: Column) -> Column:
            return F.when(F.exists(now, F.isnull), F.transform(now, lambda x, j: F.coalesce(x, F.get(v, F.pmod(F.xxhash64(j, k), F.lit(bins)).cast("int"))))).otherwise(now)

        asked = F.aggregate(F.sequence(F.lit(1), F.lit(ASKS)), v, ask)
        have = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.get(v, j).isNotNull())

        def rest(now: Column) -> Column:
            last = lambda j: F.get(v, F.array_min(F.transform(have, lambda b: F.struct(F.xxhash64(j, b).alias("h"), b.alias("b"))))["b"])
            return F.when(F.exists(now, F.isnull), F.transform(now, lambda x, j: F.coalesce(x, last(j)))).otherwise(now)

        return F.when(F.exists(v, F.isnotnull), let(asked, rest))

    return let(values, filled)


def packed(values: Column, bits: int = BITS) -> Column:
    """The low-order bits of all bins as hexadecimal digits; empty for null."""
    digits = bits // 4
    return F.coalesce(F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << bits)))), digits, "0")), ""), F.lit(""))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column."""
    return packed(densified(bins_of(shingle_hashes(F.coalesce(text, F.lit(""))))))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated similarity of the two texts' sets, 0 to 1."""
    digits, chance = bits // 4, 2.0**-bits
    equal = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substr(a, i * digits + 1, F.lit(digits)) == F.substr(b, i * digits + 1, F.lit(digits))))
    estimate = F.greatest(F.lit(0.0), (equal / F.lit(float(bins)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(estimate)


def with_next(docs: DataFrame, doc_id: str, columns: list[str], run: int = RUN) -> DataFrame:
    """Every row with the ``columns`` of the next one as struct ``next``: descending id, after the last the first.

    Ids are cut at ids of the table itself into runs of about ``run`` rows. A run is ordered on its own; the
    first row of a run is dealt to the run before as well, where it only serves as next one. Rows
    of one id are ordered by the columns; rows without an id come last. One row is its own next one.
    """
    n, most = docs.agg(F.count("*"), F.max(doc_id)).first()
    parts = min(-(-n // run), MOST_RUNS)
    cuts: list = []
    if parts > 1 and most is not None:
        shares = [k / parts for k in range(1, parts)]
        cuts = sorted({*docs.agg(F.percentile_approx(doc_id, shares, 10 * MOST_RUNS)).first()[0]} - {most}, reverse=True)
    kind = docs.schema[doc_id].dataType
    # run k holds the ids from bound k down to above bound k + 1; the first row of run k + 1 is bound k + 1
    bounds = F.lit(cuts).cast(f"array<{kind.simpleString()}>")
    last = len(cuts)
    place = _run_of(F.col(doc_id), bounds, last)
    is_first = F.equal_null(F.col(doc_id), F.get(bounds, place - 1)) if cuts else F.lit(False)
    wraps = F.equal_null(F.col(doc_id), F.lit(most).cast(kind))
    here = F.struct(place.alias("run"), F.lit(False).alias("guest"))
    copies = F.filter(F.array(here, F.when(is_first, F.struct((place - 1).alias("run"), F.lit(True).alias("guest"))),
                              F.when(wraps, F.struct(F.lit(last).alias("run"), F.lit(True).alias("guest")))), lambda x: x.isNotNull())
    dealt = docs.withColumn("_at", F.explode(copies))
    order = Window.partitionBy("_at.run").orderBy(F.col("_at.guest"), F.col(doc_id).desc_nulls_last(), *columns)
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).filter(~F.col("_at.guest")).drop("_at")


def _run_of(x: Column, bounds: Column, last: int) -> Column:
    """Number of bounds (falling) at or above x, by halving; null belongs to the last run."""
    start = F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        after = x <= F.get(bounds, middle)
        lo, hi = F.when(after, middle + 1).otherwise(s["lo"]), F.when(after, s["hi"]).otherwise(middle)
        return F.when(s["lo"] < s["hi"], F.struct(lo.alias("lo"), hi.alias("hi"))).otherwise(s)

    steps = F.sequence(F.lit(0), F.lit(last.bit_length()))
    return F.when(x.isNull(), F.lit(last)).otherwise(F.aggregate(steps, start, halve)["lo"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint, that of its edited text, and the likeness of its fingerprint to both that and the next one's.

    The edited text has the last half of the code points replaced by the first as many of the next document's.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    pairs = with_next(docs, "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    half = F.shiftright(n, 1)
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    # a wrap of one row only meets itself as guest, so next is never missing
    out = pairs.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                      likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
