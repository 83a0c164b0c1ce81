"""Quality rules on text measures and on distances to language references.

Two histograms of a text are compared with those of each language by Jensen-Shannon distance (base 2, 0 to 1): the
character classes, and the common words (the ``COMMON`` most frequent of the language, all others in one bin). The
language compared is the one whose common words overlap the text's most (Bhattacharyya coefficient; of equal ones the
last by name). References are counts over all texts with a language.

A text is rejected if it fails a base rule or lies too far from its language. Texts under ``MIN_WORDS`` words are judged
by the base rules alone, as their histograms say little. Everything runs in Spark's own functions.

NULL counts as an empty text, which fails the base rules. With no references only the base rules hold. Windows of five
words are told apart by a 64-bit hash within their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import WORD_BREAK, cut

COMMON, MIN_WORDS = 32, 30
#: Largest distances of kept texts of n words: 0.22 + 4 / n for classes, 0.02 + 3.8 / sqrt(n) for words, as the
#: histogram of a short text strays further by chance.
CLASS_LIMIT, WORD_LIMIT = (0.22, 4.0), (0.02, 3.8)
#: Removed one after the other, so that each pass reads only what is left; what no class takes are symbols.
CLASSES = {
    "lower": "[a-z]+",
    "space": WORD_BREAK,
    "upper": "[A-Z]+",
    "stop": "[.,;:'\"()?-]+",
    "digit": "[0-9]+",
    "letter": r"\p{L}+",
}
BINS = (*CLASSES, "symbol")
OWN = "_q_"  # prefix of helper columns, so that columns of the input never clash


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK), "")


def plain_words(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")


def with_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds the length of ``text`` after each removal; neighbours' differences are the class counts."""
    rest = F.col(text)
    steps = [F.length(rest)]
    for pattern in CLASSES.values():
        rest = F.regexp_replace(rest, pattern, "")
        steps.append(F.length(rest))
    return df.withColumn(f"{OWN}left", F.array(*steps))


def class_count(i: int) -> Column:
    left = F.col(f"{OWN}left")
    return left[i] - left[i + 1] if i < len(CLASSES) else left[i]


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, list, list]]:
    """(language, [(word, share)], class shares) per language; COMMON words each reach the driver."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("l"), F.col(text).alias("t")
    )
    totals = (
        with_classes(rows, "t")
        .groupBy("l")
        .agg(*[F.sum(class_count(i)).alias(b) for i, b in enumerate(BINS)])
        .collect()
    )
    counts = cut(
        rows.select("l", F.explode(plain_words(F.col("t"))).alias("w")).groupBy("l", "w").agg(F.count("*").alias("n")),
        "words",
    )
    spoken = {r.l: r.n for r in counts.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    order = Window.partitionBy("l").orderBy(F.desc("n"), "w")
    top = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= COMMON).collect()
    out = []
    for row in sorted(totals, key=lambda r: r.l):
        letters = sum(row[b] for b in BINS)
        if spoken.get(row.l) and letters:
            shares = [(r.w, r.n / spoken[row.l]) for r in sorted(top, key=lambda r: r.r) if r.l == row.l]
            out.append((row.l, shares, [row[b] / letters for b in BINS]))
    return out


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every column of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    df = docs.drop(*(n for n in names if n in docs.columns))
    df = df.withColumn(f"{OWN}text", F.coalesce(F.col(text), F.lit("")))
    t = F.col(f"{OWN}text")
    df = df.withColumn(f"{OWN}words", words_of(t)).withColumn(
        f"{OWN}lines", F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    )
    w, lines = F.col(f"{OWN}words"), F.col(f"{OWN}lines")
    df = df.withColumn(f"{OWN}each", F.transform(w, lambda x: F.xxhash64(x)))
    each = F.col(f"{OWN}each")
    hashes = F.transform(
        F.slice(each, 1, F.greatest(F.size(each) - 4, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(each, i + k) for k in range(1, 5)]),
    )
    df = df.withColumn(f"{OWN}hash", hashes)
    h = F.col(f"{OWN}hash")
    df = df.withColumn(
        f"{OWN}order",
        F.when(
            F.size(F.array_distinct(h)) < F.size(h),
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        ),
    )
    order = F.col(f"{OWN}order")
    repeated = F.sort_array(
        F.transform(
            F.filter(
                order,
                lambda x, i: (F.get(order, i - 1)["h"] == x["h"]).eqNullSafe(True)
                | (F.get(order, i + 1)["h"] == x["h"]).eqNullSafe(True),
            ),
            lambda x: x["p"],
        )
    )
    covered = F.aggregate(
        repeated,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    df = df.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    helpers = [f"{OWN}{n}" for n in ("text", "words", "each", "lines", "hash", "order")]
    return df.withColumn("base_failed", failed).drop(*helpers)


def spread(p: Column, q: Column) -> Column:
    """Twice the share of one bin in the Jensen-Shannon divergence."""
    def side(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))

    return side(p) + side(q)


def distances(df: DataFrame, known: list[tuple[str, list, list]], text: str = "text") -> DataFrame:
    """Adds word_distance and class_distance to the nearest language; NULL if there is none."""
    if not known:
        return df.withColumns({"word_distance": F.lit(None).cast("double"), "class_distance": F.lit(None).cast("double")})
    shares_of = sorted(((q, w) for _, shares, _ in known for w, q in shares), reverse=True)
    every = list(dict.fromkeys(w for _, w in shares_of))  # the most frequent first, where they are found soonest
    longest = max(map(len, every))
    df = df.withColumn(f"{OWN}text", F.coalesce(F.col(text), F.lit("")))
    df = with_classes(df, f"{OWN}text").withColumn(f"{OWN}plain", plain_words(F.col(f"{OWN}text")))
    numbers = F.transform(
        F.col(f"{OWN}plain"),
        lambda w: F.when(F.length(w) <= longest, F.find_in_set(w, F.lit(",".join(every)))).otherwise(0),
    )
    df = df.withColumn(f"{OWN}ids", F.sort_array(F.array_remove(numbers, 0)))
    df = df.withColumn(f"{OWN}kinds", F.array_distinct(f"{OWN}ids"))
    ids, kinds, n = F.col(f"{OWN}ids"), F.col(f"{OWN}kinds"), F.size(f"{OWN}plain")
    df = df.withColumn(f"{OWN}at", F.transform(kinds, lambda k: F.array_position(ids, k)))
    at = F.col(f"{OWN}at")
    parts = F.transform(
        kinds, lambda k, i: F.struct(k.alias("k"), ((F.coalesce(F.get(at, i + 1), F.size(ids) + 1) - F.get(at, i)) / n).alias("p"))
    )
    df = df.withColumn(f"{OWN}parts", parts)

    size = F.length(f"{OWN}text")
    df = df.withColumn(f"{OWN}shares", F.array(*[F.try_divide(class_count(i), size) for i in range(len(BINS))]))

    def reference(name: str, words: list, shares: list) -> Column:
        q = dict(words)
        return F.struct(
            F.lit(name).alias("l"),
            F.array(*[F.lit(float(q.get(w, 0.0))) for w in every]).alias("q"),
            F.lit(float(sum(q.values()))).alias("total"),
            F.array(*[F.lit(float(x)) for x in shares]).alias("classes"),
        )

    def word_distance(r: Column) -> Column:
        def add(a: Column, x: Column) -> Column:
            q = F.get(r["q"], x["k"] - 1)
            return F.when(
                q > 0,
                F.struct((a["js"] + spread(x["p"], q)).alias("js"), (a["p"] + x["p"]).alias("p"), (a["q"] + q).alias("q")),
            ).otherwise(a)

        def close(a: Column) -> Column:
            rest = spread(F.greatest(1 - a["p"], F.lit(0.0)), F.greatest(1 - r["total"], F.lit(0.0)))
            return F.sqrt(F.greatest(F.lit(0.0), (a["js"] + (r["total"] - a["q"]) + rest) / 2))

        zero = F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
        return F.aggregate(F.col(f"{OWN}parts"), zero, add, close)

    def class_distance(r: Column) -> Column:
        parts = F.zip_with(F.col(f"{OWN}shares"), r["classes"], spread)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2))

    references_of = F.array(*[reference(*k) for k in known])
    def closeness(r: Column) -> Column:
        return F.aggregate(
            F.col(f"{OWN}parts"), F.lit(0.0), lambda a, x: a + F.sqrt(x["p"] * F.get(r["q"], x["k"] - 1))
        )

    nearest = F.array_max(F.transform(references_of, lambda r: F.struct(closeness(r).alias("near"), r.alias("r"))))
    df = df.withColumn(f"{OWN}near", nearest["r"])
    near = F.col(f"{OWN}near")
    df = df.withColumns({"word_distance": word_distance(near), "class_distance": class_distance(near)})
    return df.drop(*(f"{OWN}{c}" for c in ("text", "left", "plain", "ids", "kinds", "at", "parts", "shares", "near")))


def judged(docs: DataFrame, known: list[tuple[str, list, list]], text: str = "text") -> DataFrame:
    """``measures`` and ``distances`` of each row, and kept."""
    df = distances(measures(docs, text), known, text)
    n = F.greatest(F.col("n_words"), F.lit(1))
    far = (F.col("class_distance") > CLASS_LIMIT[0] + CLASS_LIMIT[1] / n) | (
        F.col("word_distance") > WORD_LIMIT[0] + WORD_LIMIT[1] / F.sqrt(n)
    )
    judged_by_rules = (n < MIN_WORDS) | ~F.coalesce(far, F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & judged_by_rules)


def accepted(docs: DataFrame, known: list[tuple[str, list, list]], text: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with their own columns, whatever those are called."""
    rows = docs.select(F.struct("*").alias(f"{OWN}row"), F.col(text).alias(f"{OWN}body"))
    # The row number, part of the condition, keeps the optimiser from moving the filter below the steps, which would
    # repeat each of them many times.
    found = judged(rows, known, f"{OWN}body").withColumn(f"{OWN}number", F.monotonically_increasing_id())
    return found.filter(F.col("kept") & (F.col(f"{OWN}number") >= 0)).select(f"{OWN}row.*")
