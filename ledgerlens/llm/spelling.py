"""Spelling variants: words one edit apart, grouped under the much more frequent form.

Asymmetric q-chunks. Of two words that are one inserted, deleted or replaced code point apart, the shorter (or either, if
equally long) contributes two disjoint chunks, its halves; the other contributes its grams with their positions. One edit lies in one
half only, so the other half stands whole in the longer word, shifted by one place at most. A half alone is too frequent a key
(endings, prefixes): the rule is applied once more to the half with the edit, one of whose own two
chunks stands whole again. Words therefore meet on a whole half and a chunk of the other half, with length and positions fixed
(the gram side offers a gram for a shift of 0 and, for words one longer, of 1); what meets is verified by the edit distance.
Only about a quarter of a word is free within such a key, so no ending or prefix becomes a hot key.

Defined results: a null or empty text has no words; a document without id has the id '' where ids count; repeated
rows count as often as they stand; ties go to the smaller word in code-point order; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.stored import stored

#: Letters of a word: basic Latin and the upper half of Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, RATIO = 7, 2, 10


def runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, run): every maximal run of at least ``shortest`` letters in every whole text, with only A-Z lower-cased."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    # lower() is much faster than translate(), and equal to it without other capitals
    small = F.when(F.rlike("run", F.lit(r"[À-Þ]")), F.translate("run", CAPITALS, SMALL)).otherwise(F.lower("run"))
    return found.select("doc_id", small.alias("run"))


def counted(words: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the column ``word``: words of at least ``shortest`` code points that occur ``least`` times."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _cut(word: F.Column, start: F.Column, n: F.Column) -> F.Column:
    """``n`` code points from the 0-based ``start``."""
    return F.substring(word, start + 1, n)


def _keys(word: F.Column, owner: F.Column, shift: int) -> F.Column:
    """Four keys (kind, whole half and chunk of the other half) for a chunk word of ``owner`` code points.

    With ``shift`` 0 these are the word's own chunks, or the grams at the same places of a word as long; with 1 the grams of a word
    one longer, in which whatever follows the edit stands one place further on.
    """
    a, whole = F.ceil(owner / 2).cast("int"), owner
    b = whole - a
    a1, b1 = F.ceil(a / 2).cast("int"), F.ceil(b / 2).cast("int")
    first, second = _cut(word, F.lit(0), a), _cut(word, a + shift, b)
    chunks = [
        (first, _cut(word, a, b1)), (first, _cut(word, a + b1 + shift, b - b1)),
        (second, _cut(word, F.lit(0), a1)), (second, _cut(word, a1 + shift, a - a1))]
    return F.array(*[F.struct(F.lit(kind).alias("kind"), F.concat(half, chunk).alias("gram")) for kind, (half, chunk) in enumerate(chunks)])


def near_pairs(words: DataFrame) -> DataFrame:
    """Each unordered pair of words (a, n_a, b, n_b) exactly one edit apart, once; ``words`` (word, n) has distinct words."""
    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), size.alias("owner"), F.inline(_keys(F.col("word"), size, 0)))
    same = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), size.alias("owner"), F.inline(_keys(F.col("word"), size, 0)))
    longer = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), (size - 1).alias("owner"), F.inline(_keys(F.col("word"), size - 1, 1)))
    met = chunks.join(same.unionAll(longer), ["owner", "kind", "gram"])
    once = (F.length("b") > F.col("owner")) | (F.col("a") < F.col("b"))
    return met.where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last form reached from each word of (word, form), by pointer doubling.

    A form is ``RATIO`` times as frequent as its word, so chains have no cycle and at most 18 links; rounds are few.
    """
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if at.join(on, "root", "left_semi").isEmpty():
            return at
        at = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n).

    ``form`` is the most frequent word one edit away, if it is at least ``ratio`` times as frequent; ``root`` is where forms lead.
    """
    words = stored(words.select("word", "n"))
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("near")).alias("best")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("n"), F.col("a").alias("near")).alias("best")))
    near = pairs.select(F.inline(sides)).groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    frequent = -F.col("best.n") >= ratio * F.col("n")
    joined = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.n")).alias("form_n")))
    ends = roots(joined.where("form IS NOT NULL"))
    return joined.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
