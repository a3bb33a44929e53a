"""Corpus words: frequencies, glued words and likely misspellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import materialize

FREQUENT = 8
MIN_WORD = 6
RARE_MAX = 2
RATIO = 4
LONG_WORD = 40


def split_words(c: T.C, kind: str = "alpha") -> Column:
    """Lower-case words: letters only, or letters and digits."""
    if kind == "alnum":
        return T.tokens(c)
    return F.filter(F.split(F.lower(T.col(c)), "[^a-z]+"), lambda t: t != "")


def token_frequency(df: DataFrame, columns: list[str], kind: str = "alpha") -> DataFrame:
    """``(token, freq, len)``; counts combine before the shuffle."""
    text = F.concat_ws(" ", *columns)
    return (
        T.exploded(df, split_words(text, kind), "token")
        .groupBy("token")
        .agg(F.count("*").alias("freq"))
        .withColumn("len", F.length("token"))
    )


def split_glued_tokens(names: DataFrame, freq: DataFrame, code: str = "code", name: str = "name") -> DataFrame:
    """Words absent from the corpus that split into two frequent words.

    Returns ``(code, original, corrected)``. Names and corpus are two inputs: a
    word of the corpus itself is never absent from it.
    """
    parts = names.select(
        code, name, F.posexplode(F.split(F.col(name), r"(?<=\s)(?=\S)|(?<=\S)(?=\s)")).alias("pos", "raw")
    )
    words = (
        parts.where(F.col("raw").rlike("^[A-Za-z]+$") & (F.length("raw") >= MIN_WORD))
        .select(F.lower("raw").alias("word"))
        .distinct()
        .join(freq.select(F.col("token").alias("word")), "word", "left_anti")
    )
    frequent = freq.where((F.col("freq") >= FREQUENT) & (F.col("len") >= 3)).select("token")
    # Both halves are frequent words, so no longer word can split.
    longest = frequent.agg(F.max(F.length("token")).alias("n")).scalar()
    cuts = words.where(F.length("word") <= longest * 2).select(
        "word", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("cut")
    ).select(
        "word",
        "cut",
        F.substring(F.col("word"), F.lit(1), F.col("cut")).alias("left"),
        F.substring(F.col("word"), F.col("cut") + 1, F.length("word")).alias("right"),
    )
    found = (
        cuts.join(frequent.select(F.col("token").alias("left")), "left")
        .join(frequent.select(F.col("token").alias("right")), "right")
        .groupBy("word")
        .agg(F.min("cut").alias("cut"))
        .select(
            "word",
            F.concat(
                F.substring(F.col("word"), F.lit(1), F.col("cut")),
                F.lit(" "),
                F.substring(F.col("word"), F.col("cut") + 1, F.length("word")),
            ).alias("fixed"),
        )
    )
    joined = parts.withColumn("word", F.lower("raw")).join(found, "word", "left")
    # Pieces of one name: a bounded list, put back in order.
    rebuilt = joined.groupBy(code).agg(
        F.max(name).alias("original"),
        F.max(F.col("fixed").isNotNull()).alias("changed"),
        F.array_sort(
            F.collect_list(F.struct("pos", F.coalesce("fixed", "raw").alias("piece")))
        ).alias("pieces"),
    )
    return rebuilt.where("changed").select(
        code, "original", F.array_join(F.col("pieces")["piece"], "").alias("corrected")
    )


def _shortened(words: DataFrame, word: str, depth: Column) -> DataFrame:
    """One row per form of a word with up to ``depth`` (1 or 2) letters removed.

    The first letter stays: neighbours share it, and an equal first letter never
    needs an edit. Positions are exploded rather than built as arrays, so the
    forms are generated code. The pair past the end removes nothing.
    """
    n = F.length(word)
    cut = words.withColumn("i", F.explode(F.sequence(F.lit(2), n + 1)))
    last = F.when((depth >= 2) & (F.col("i") <= n), n).otherwise(F.col("i"))
    cut = cut.withColumn("j", F.explode(F.sequence(F.col("i"), last)))
    i, j, w = F.col("i"), F.col("j"), F.col(word)
    form = F.concat(
        F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.greatest(j - i - 1, F.lit(0))), F.substring(w, j + 1, n)
    )
    return cut.withColumn("form", form).drop("i", "j")


def _segments(n: Column, pieces: int) -> list[tuple[Column, Column]]:
    """Start and length of each of ``pieces`` near-equal segments."""
    base = F.floor(n / pieces).cast("int")
    out = []
    for i in range(pieces):
        start = base * i + 1
        size = base if i < pieces - 1 else n - base * (pieces - 1)
        out.append((start, size))
    return out


def _candidates_short(rare: DataFrame, common: DataFrame) -> DataFrame:
    """Pairs that share a form with at most ``cap`` letters removed from each."""
    left = _shortened(rare.where(F.col("len") <= LONG_WORD).select("token", "freq", "cap"), "token", F.col("cap"))
    near = common.where(F.col("nlen") <= LONG_WORD + 2)
    right = _shortened(near, "neighbour", F.when(F.col("nlen") >= 7, 2).otherwise(1)).drop("nlen")
    return left.join(right, "form").drop("form")


def _candidates_long(rare: DataFrame, common: DataFrame) -> DataFrame:
    """Long words: two edits leave one of three segments of the rare word intact."""
    tokens = rare.where(F.col("len") > LONG_WORD)
    segs = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                start.cast("int").alias("start"),
                F.substring(F.col("token"), start, size).alias("part"),
            )
            for i, (start, size) in enumerate(_segments(F.col("len"), 3))
        ]
    )
    left = tokens.select("token", "freq", "cap", "len", F.explode(segs).alias("s")).select(
        "token", "freq", "cap", "len", F.col("s.i").alias("i"), F.col("s.part").alias("part")
    )
    # The neighbour offers, for every rare length within two, the substrings at
    # each segment's place shifted by at most two.
    right = common.where(F.col("nlen") > LONG_WORD - 2).select(
        "neighbour", "nfreq", "nlen",
        F.explode(F.sequence(F.col("nlen") - 2, F.col("nlen") + 2)).alias("len"),
    )

    def shifted(i: int, start: Column, size: Column) -> Column:
        spots = F.sequence(F.greatest(start - 2, F.lit(1)), start + 2)
        return F.transform(
            spots,
            lambda at: F.struct(F.lit(i).alias("i"), F.substring(F.col("neighbour"), at, size).alias("part")),
        )

    places = F.flatten(
        F.array(*[shifted(i, start, size) for i, (start, size) in enumerate(_segments(F.col("len"), 3))])
    )
    right = right.select("neighbour", "nfreq", "len", F.explode(F.array_distinct(places)).alias("s")).select(
        "neighbour", "nfreq", "len", F.col("s.i").alias("i"), F.col("s.part").alias("part")
    )
    return left.join(right, ["len", "i", "part"]).select("token", "freq", "cap", "neighbour", "nfreq")


def misspelling_candidates(words: DataFrame, freq: DataFrame) -> DataFrame:
    """Rare words with a much more frequent neighbour within one or two edits.

    ``words`` holds ``token``: the words to judge. Candidate pairs come from
    equality on shortened forms, never from all pairs of a block, and the edit
    distance decides. Flags only. Returns ``(token, freq, neighbour, nfreq, dist)``.
    The frequencies are counted once and kept as a table.
    """
    held = materialize(freq, "frequency")
    words, freq = held if words is freq else words, held
    rare = (
        words.select("token").distinct()
        .join(freq, "token")
        .where((F.length("token") >= MIN_WORD) & F.col("freq").between(1, RARE_MAX))
        .withColumn("cap", F.when(F.col("len") >= 9, 2).otherwise(1))
    )
    common = freq.where((F.col("freq") >= FREQUENT) & (F.col("len") >= MIN_WORD - 1)).select(
        F.col("token").alias("neighbour"), F.col("freq").alias("nfreq"), F.col("len").alias("nlen")
    )
    pairs = _candidates_short(rare, common).unionByName(_candidates_long(rare, common))
    judged = (
        pairs.where(
            (F.substring("token", 1, 1) == F.substring("neighbour", 1, 1))
            & (F.col("nfreq") >= F.col("freq") * RATIO)
            & (F.col("token") != F.col("neighbour"))
        )
        .withColumn("dist", F.levenshtein("token", "neighbour", 2))
        .where((F.col("dist") >= 1) & (F.col("dist") <= F.col("cap")))
    )
    best = F.min_by(
        F.struct("freq", "neighbour", "nfreq", "dist"),
        F.struct(F.col("dist"), -F.col("nfreq"), F.length("neighbour"), F.col("neighbour")),
    )
    return judged.groupBy("token").agg(best.alias("b")).select("token", "b.*")
