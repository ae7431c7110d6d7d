"""Document fingerprints from spot signatures: chains of content words that follow common words.

Words are runs of letters and digits in lower case. At every common word (an antecedent) the next ``CHAIN`` content
words, common words skipped, form a signature with it. A text's fingerprint is the sorted set of its signatures' hashes;
likeness is the Jaccard index of two sets. Sets whose sizes differ too much for a wanted likeness are never compared:
they lie in other length partitions, and within a partition the quotient of sizes bounds the likeness first.
All work is DataFrame expressions.

Defined cases: a text without antecedents or with too few content words after each has one signature, of all its words;
one without words has the signature of the text itself; null and empty texts have none. Two empty sets are equal
(likeness 1), an empty and another set differ (0). The next document is the next by id, nulls first and ties by text,
and after the last comes the first; a lone document follows itself. Repeated rows are documents of their own. Other
columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut

# Common words of English, German, French and Spanish.
ANTECEDENTS = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she so that the their them they "
    "this to was were which who will with you "
    "als am auf aus bei das dem den der des die du ein eine einem einen einer er es hat ich im ist mit nicht oder sich sie sind "
    "und vom von vor war wie wir zu zum zur für über "
    "au aux avec ce ces cette dans de elle en est et il ils je la le les leur lui mais ne nous ou par pas pour qu que qui sa se "
    "ses son sont sur un une vous à du "
    "al como con del el ella ellos era esta este ha las lo los me mi más no nos o para pero por si sin sobre su sus te tu una y yo ya"
).split()
CHAIN = 2
#: Hex digits of a signature's hash.
DIGITS = 12
_SPLIT = r"[^\p{L}\p{N}]+"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it inside lambdas."""
    return F.transform(F.array(value), use)[0]


def signatures(text: Column) -> Column:
    """The sorted set of a text's signatures."""

    def of_words(words: Column) -> Column:
        spots = F.filter(
            F.transform(words, lambda w, i: F.when(w.isin(ANTECEDENTS), i)), lambda i: i.isNotNull()
        )
        content = F.filter(words, lambda w: ~w.isin(ANTECEDENTS))
        # The k-th antecedent at place p has p - k content words before it.
        chains = lambda at, rest: F.transform(
            F.filter(F.transform(at, lambda p, k: F.struct(p.alias("p"), (p - k).alias("c"))), lambda s: s["c"] + CHAIN <= F.size(rest)),
            lambda s: F.concat_ws(" ", F.get(words, s["p"]), *[F.get(rest, s["c"] + j) for j in range(CHAIN)]),
        )
        return _let(spots, lambda at: _let(content, lambda rest: chains(at, rest)))

    def marks(t: Column) -> Column:
        words = F.filter(F.split(F.lower(t), _SPLIT), lambda w: w != "")
        return _let(
            words,
            lambda ws: _let(
                of_words(ws),
                lambda found: F.when(t == "", F.array().cast("array<string>"))
                .when(F.size(ws) == 0, F.array(t))
                .when(F.size(found) == 0, F.array(F.concat_ws(" ", ws)))
                .otherwise(found),
            ),
        )

    hashed = lambda found: F.transform(found, lambda s: F.substring(F.md5(s), 1, DIGITS))
    return F.array_sort(F.array_distinct(hashed(_let(F.coalesce(text, F.lit("")), marks))))


def fingerprint(found: Column) -> Column:
    """The signatures end to end."""
    return F.array_join(found, "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard index of two sets; 0 without comparing them where their sizes alone keep it under ``least``."""
    common = F.size(F.array_intersect(a, b))
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < least * large), 0.0)
        .otherwise(_let(common, lambda n: n / (F.size(a) + F.size(b) - n)))
    )


def partition(size: Column, least: float) -> Column:
    """Length partition: sets at least ``least`` alike lie in the same one or in neighbouring ones."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / -math.log(least) + 1e-9).cast("int")).otherwise(-1)


def near(docs: DataFrame, least: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Near-duplicate links: ``(members, links)``.

    ``members`` (doc_id, class_id) maps every document to the smallest id with its fingerprint; ``links`` (a, b,
    likeness) holds the pairs of classes at least ``least`` alike. Classes of neighbouring length partitions meet on
    the rarest signatures of each: two sets that are alike enough share one of their ``n - ceil(least * n) + 1`` rarest.
    """
    sets = docs.select(F.col(doc_id).alias("doc_id"), signatures(F.col(text)).alias("found"))
    keyed = cut(sets.withColumn("print", F.sha2(fingerprint(F.col("found")), 256)))
    classes = keyed.groupBy("print").agg(F.min("doc_id").alias("class_id"), F.first("found").alias("found"))
    members = keyed.select("doc_id", "print").join(classes.select("print", "class_id"), "print").select("doc_id", "class_id")
    held = cut(classes.where(F.size("found") > 0).select("class_id", "found", F.size("found").alias("n")))
    spread = held.select("class_id", "n", F.explode("found").alias("mark"))
    often = spread.groupBy("mark").agg(F.count("*").alias("often"))
    order = Window.partitionBy("class_id").orderBy("often", "mark")
    rare = (
        spread.join(often, "mark")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
        .select("class_id", "n", "mark", partition(F.col("n"), least).alias("part"))
    )
    left = rare.select("mark", "part", F.col("class_id").alias("a"), F.col("n").alias("n_a"))
    right = rare.select(
        "mark", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"), F.col("class_id").alias("b"), F.col("n").alias("n_b")
    )
    fits = F.least("n_a", "n_b") >= F.lit(least) * F.greatest("n_a", "n_b") - 1e-9
    pairs = left.join(right, ["mark", "part"]).where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    side = lambda name: held.select(F.col("class_id").alias(name), F.col("found").alias(f"found_{name}"))
    links = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .select("a", "b", likeness(F.col("found_a"), F.col("found_b"), least).alias("likeness"))
        .where(F.col("likeness") >= least)
    )
    return members, links


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are smaller than the key, by binary search; -1 for null."""
    array = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(0))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: _let(
        middle(s),
        lambda m: F.when((s["lo"] < s["hi"]) & (F.get(array, m) < key), F.struct((m + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(
            F.struct(s["lo"].alias("lo"), F.when(s["lo"] < s["hi"], m).otherwise(s["hi"]).alias("hi"))
        ),
    )
    rounds = F.sequence(F.lit(1), F.lit(max(1, len(bounds)).bit_length() + 1))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), step)["lo"]
    return F.when(key.isNull(), -1).otherwise(found)


def with_next(spark: SparkSession, docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows (doc_id, text, found, next_text, next_found): each document with the next one by id.

    Ids are cut into ranges of about equal numbers of rows; each range is a window, with the first document of the
    range after it as a last row. So no window holds more than a range. ``ranges``: eight for each shuffle partition.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = ranges or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = base.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("cuts")).first().cuts
    placed = base.withColumn("range", _range_of(F.col("doc_id"), sorted(set(cuts or []))))
    firsts = placed.groupBy("range").agg(F.min("doc_id").alias("doc_id")).select("range", F.col("doc_id").alias("first"))
    known = sorted(firsts.collect(), key=lambda r: r.range)  # one row for each range
    if not known:
        known = [(0, None)]
    before = [(*row, known[i - 1][0]) for i, row in enumerate(known)]  # before the first range comes the last
    heads = spark.createDataFrame(before, "range int, first long, into int").select(F.col("range").alias("_range"), "first", "into")
    on = (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("first"))
    ends = placed.join(F.broadcast(heads), on).groupBy(F.col("into").alias("range"), "doc_id").agg(F.min("text").alias("text"))
    rows = placed.withColumn("end", F.lit(False)).unionByName(ends.withColumn("end", F.lit(True)))
    order = Window.partitionBy("range").orderBy("end", F.col("doc_id").asc_nulls_first(), "text")
    return (
        rows.repartition("range")
        .withColumn("found", signatures(F.col("text")))
        .withColumns({"next_text": F.lead("text").over(order), "next_found": F.lead("found").over(order)})
        .where("not end")
        .drop("range", "end")
    )


def edited(text: Column, other: Column) -> Column:
    """The text with its last quarter replaced by as much of the start of another."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(other, F.lit(1), quarter))


def sql() -> str:
    """The registered query in DuckDB."""
    listed = ", ".join(f"'{w}'" for w in sorted(set(ANTECEDENTS)))
    chain = " || ' ' || ".join(f"rest[spots[k] - k + {j + 1}]" for j in range(CHAIN))

    def prints(name: str, source: str, text: str) -> str:
        return f"""
{name}_w AS MATERIALIZED (SELECT doc_id, {text} AS t, list_filter(string_split_regex(lower({text}), '{_SPLIT}'), lambda w: w <> '') AS ws FROM {source}),
{name}_s AS MATERIALIZED (SELECT doc_id, t, ws, list_filter(range(1, len(ws) + 1), lambda i: list_contains(common, ws[i])) AS spots,
  list_filter(ws, lambda w: NOT list_contains(common, w)) AS rest FROM {name}_w, words),
{name}_c AS MATERIALIZED (SELECT doc_id, t, ws, list_transform(list_filter(range(1, len(spots) + 1), lambda k: spots[k] - k + {CHAIN} <= len(rest)),
  lambda k: ws[spots[k]] || ' ' || {chain}) AS found FROM {name}_s),
{name} AS MATERIALIZED (SELECT doc_id, t, list_sort(list_distinct(list_transform(
  CASE WHEN t = '' THEN [] WHEN len(ws) = 0 THEN [t] WHEN len(found) = 0 THEN [array_to_string(ws, ' ')] ELSE found END,
  lambda s: substr(md5(s), 1, {DIGITS})))) AS found FROM {name}_c)"""

    def like(a: str, b: str) -> str:
        common = f"len(list_intersect({a}, {b}))"
        return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE {common}::DOUBLE / (len({a}) + len({b}) - {common}) END"

    return f"""
WITH words AS (SELECT [{listed}] AS common),
base AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{prints("own", "base", "text")},
follow AS MATERIALIZED (SELECT doc_id, t, found, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t,
  coalesce(lead(found) OVER w, first_value(found) OVER w) AS next_found FROM own WINDOW w AS (ORDER BY doc_id)),
changed AS MATERIALIZED (SELECT doc_id, substr(t, 1, length(t) - length(t) // 4) || substr(next_t, 1, length(t) // 4) AS e FROM follow),
{prints("new", "changed", "e")}
SELECT f.doc_id, length(f.t) AS n_chars, sha256(n.t) AS edited_sha256, array_to_string(f.found, '') AS fingerprint,
  array_to_string(n.found, '') AS edited_fingerprint, round({like("f.found", "n.found")}, 9) AS near_edited,
  round({like("f.found", "f.next_found")}, 9) AS near_next
FROM follow f JOIN new n USING (doc_id)"""
