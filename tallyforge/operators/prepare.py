"""Dataset preparation: deterministic group splits, schemas, exclusions, coverage and length profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ranks import exact_percentiles
from tallyforge.sources.io import materialise

SPLITS = ["train", "validation", "test"]


def group_split(groups: DataFrame, seed: str, train: int = 106, validation: int = 23, key: str = "agreement_id") -> DataFrame:
    """(key, split): distinct groups in the order of a seeded hash, the first to train, the next to validation.

    The order is global, over distinct group keys alone (documents, not rows).
    """
    distinct = groups.select(key).distinct()
    rank = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256)))
    return distinct.withColumn("rn", rank).select(key, F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + validation, "validation").otherwise("test").alias("split"))


def propagate_split(rows: DataFrame, assignment: DataFrame, key: str = "agreement_id") -> DataFrame:
    """Rows with the split of their group. Rows stay where they are: groups are few, ordered in one task before, and some have
    a large part of all rows, so their table goes to the rows."""
    return rows.join(F.broadcast(assignment), key)


def binary_target(subquestion: Column, answer: Column) -> tuple[Column, Column]:
    """(label expected, target): whether the subquestion is among the answer's parts; the raw answer without subquestion."""
    has = F.array_contains(F.split(answer, ", "), subquestion)
    plain = subquestion == "<NONE>"
    return F.when(~plain, has.cast("int")), F.when(plain, answer).when(has, subquestion).otherwise("<OTHER>")


def task_schema(rows: DataFrame) -> DataFrame:
    """Per task: its attributes (question, subquestion, category and, where there is one, text type), how many different
    combinations of them it has, and the ordered answers."""
    pairs = F.array_sort(F.collect_set(F.struct("label", "target")))
    attributes = [F.coalesce(c, F.lit("")) for c in ("question", "subquestion", "category", "text_type") if c in rows.columns]
    return rows.groupBy("task_id").agg(F.min("question").alias("question"), F.min("subquestion").alias("subquestion"), F.min("category").alias("category"), F.size(F.collect_set(F.struct(*attributes))).alias("n_attributes"), pairs.alias("pairs")).withColumn("answers", F.transform("pairs", lambda p: p["target"]))


def schema_violations(rows: DataFrame, least: int = 2, most: int = 26) -> DataFrame:
    """(rule, task_id) for every broken rule of a task's schema."""
    s = task_schema(rows).withColumn("labels", F.transform("pairs", lambda p: p["label"]))
    rules = [
        ("attributes", F.col("n_attributes") != 1),
        ("label_to_answer", F.size(F.array_distinct("labels")) != F.size("labels")),
        ("dense_labels", F.array_max("labels") != F.size(F.array_distinct("labels")) - 1),
        ("label_count", ~F.size("labels").between(least, most)),
        ("distinct_answers", F.size(F.array_distinct("answers")) != F.size("answers")),
    ]
    broken = s.select("task_id", F.explode(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules]), lambda r: r.isNotNull())).alias("rule"))
    twice = s.groupBy("question", "subquestion").agg(F.count("*").alias("n"), F.min("task_id").alias("task_id")).where("n > 1").select("task_id", F.lit("duplicate_question").alias("rule"))
    return broken.unionByName(twice).select("rule", "task_id")


def split_profile(rows: DataFrame) -> DataFrame:
    """Rows and distinct groups by split and data type, with totals by split, in one pass."""
    return rows.rollup("split", "data_type").agg(F.count("*").alias("n"), F.count_distinct("agreement_id").alias("agreements")).where("split is not null")


def in_all(rows: DataFrame, by: str, key: str, values: int) -> DataFrame:
    """Keys that occur under every one of ``values`` different values of ``by``."""
    return rows.groupBy(key).agg(F.count_distinct(by).alias("n")).where(F.col("n") == values).select(key)


def exclusions(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows with a reason to leave them out (first rule wins), else null."""
    known = assignment.select("agreement_id", F.lit(True).alias("known"))
    return rows.join(known, "agreement_id", "left").withColumn("reason", F.when(F.col("data_type") == "rare_answers", "rare_answers").when(F.col("known").isNull(), "agreement_not_assigned")).drop("known")


def integrity(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows whose text is blank or whose answer is not the schema's for their label."""
    joined = rows.join(tasks.select("task_id", "answers"), "task_id", "left")
    blank = F.regexp_replace("text", r"(?U)\s+", "") == ""
    wrong = ~F.coalesce(F.get("answers", F.col("label")).eqNullSafe(F.col("target")), F.lit(False))
    return joined.select("example_id", F.when(blank, "blank_text").when(wrong, "answer_mismatch").alias("rule")).where("rule is not null")


def label_spine(tasks: DataFrame) -> DataFrame:
    """Every valid label of every task, supported or not."""
    return tasks.select("task_id", "question", "category", F.posexplode("answers").alias("label", "answer"))


def coverage_cells(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task, split, label): examples and distinct groups, zero where there are none."""
    counted = rows.groupBy("task_id", "split", "label").agg(F.count("*").alias("examples"), F.count_distinct("agreement_id").alias("agreements"))
    spine = label_spine(tasks).select("task_id", "label").withColumn("split", F.explode(F.array(*map(F.lit, SPLITS))))
    return spine.join(counted, ["task_id", "split", "label"], "left").fillna(0, ["examples", "agreements"])


def coverage(rows: DataFrame, tasks: DataFrame, least_groups: int = 10, least_label_groups: int = 3, rare_share: float = 0.1) -> DataFrame:
    """Per task from training support: eligibility, and its unsupported, rare and thinly supported labels."""
    train = rows.where("split = 'train'")
    whole = train.groupBy("task_id").agg(F.count("*").alias("examples"), F.count_distinct("agreement_id").alias("agreements"))
    cells = coverage_cells(train, tasks).where("split = 'train'").select("task_id", "label", F.col("examples").alias("n"), F.col("agreements").alias("groups"))
    joined = cells.join(whole, "task_id", "left").fillna(0, ["examples", "agreements"])

    def labels(condition):
        return F.array_sort(F.collect_list(F.when(condition, F.col("label"))))

    return joined.groupBy("task_id").agg(
        F.max("examples").alias("train_examples"), F.max("agreements").alias("train_agreements"),
        ((F.max("agreements") >= least_groups) & (F.sum(F.when(F.col("groups") >= least_label_groups, 1).otherwise(0)) >= 2)).alias("eligible"),
        labels(F.col("n") == 0).alias("unsupported_labels"), labels(F.col("n") / F.greatest(F.lit(1), F.col("examples")) <= rare_share).alias("rare_labels"), labels(F.col("groups") < least_label_groups).alias("thin_labels"),
    )


def duplicate_documents(rows: DataFrame, content: str) -> DataFrame:
    """How many rows repeat another's content."""
    return rows.agg((F.count("*") - F.count_distinct(F.sha2(F.col(content), 256))).alias("duplicates"))


def audit_summary(rows: DataFrame, cover: DataFrame) -> DataFrame:
    """(name, value) of the counts that describe a prepared dataset."""
    a = rows.agg(F.count("*").alias("rows"), F.count_distinct("agreement_id").alias("agreements"), F.count_distinct("task_id").alias("tasks"), F.count_distinct("question").alias("parents"), *[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in SPLITS])
    both = a.crossJoin(F.broadcast(cover.agg(F.count(F.when(F.col("eligible"), 1)).alias("eligible"))))  # two single rows
    return both.unpivot([], ["rows", "agreements", "tasks", "parents", *SPLITS, "eligible"], "name", "value")


def length_percentiles(rows: DataFrame, column: str = "prompt_tokens") -> DataFrame:
    """Exact percentiles by split, linear between ranks."""
    p = exact_percentiles(rows, ["split"], column, [0.5, 0.9, 0.95, 0.99]).withColumnRenamed("split", "tf_split")
    both = rows.groupBy("split").agg(F.max(column).alias("longest")).join(p, F.col("split").eqNullSafe(F.col("tf_split")))
    return both.select("split", *[F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(["p50", "p90", "p95", "p99"])], "longest")


def context_size(rows: DataFrame, supervised: Column, least_new: int = 8, step: int = 256, most: int = 32768) -> DataFrame:
    """The smallest multiple of ``step`` that holds every prompt with its answer, and whether it is allowed."""
    size = (F.ceil(F.max(F.col("prompt_tokens") + F.greatest(supervised, F.lit(least_new))) / step) * step).cast("long")
    return rows.agg(size.alias("context")).withColumn("allowed", F.col("context") <= most)


def length_bucket(tokens: Column) -> Column:
    return F.when(F.coalesce(tokens, F.lit(0)) == 0, "unknown").when(tokens <= 1024, "0-1024").when(tokens <= 2048, "1025-2048").when(tokens <= 4096, "2049-4096").otherwise("4097+")


def row_json(columns: list[str]) -> Column:
    """The JSON of a row with its keys in order, whatever the order of its columns."""
    return F.struct(*sorted(columns))


def restore(rows: DataFrame, assignment: DataFrame, excluded: DataFrame, present: DataFrame) -> DataFrame:
    """The rows of the splits that are not ``present`` (split), under the assignment that is there: never a new one."""
    missing = assignment.join(F.broadcast(present.select("split").distinct()), "split", "left_anti")  # a handful of splits
    return rows.join(missing, "agreement_id").join(excluded.select("example_id"), "example_id", "left_anti")


def content_id(name: Column, number: Column, row: Column) -> Column:
    """name:row:hash of the row's JSON."""
    return F.concat_ws(":", name, number.cast("string"), F.substring(F.sha2(F.to_json(row), 256), 1, 16))


#: Parts in which two tables are compared by their fingerprints.
PARTS = 4096


def fingerprints(df: DataFrame, parts: int = PARTS) -> DataFrame:
    """(part, n, a, b): rows of each part of a table and sums of two hashes of them, whatever their order.

    Sums see repeated rows, which a set of hashes would not. A null counts as a value of its own in its column.
    """
    told = [F.col(f"`{c}`").isNull() for c in df.columns]
    hashes = [F.xxhash64(F.lit(s), *[F.col(f"`{c}`") for c in df.columns], *told) for s in (1, 2)]
    return df.select(*[h.alias(n) for h, n in zip(hashes, "ab", strict=True)]).groupBy(F.pmod("a", F.lit(parts)).alias("part")).agg(F.count("*").alias("n"), *[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in "ab"])


def differences(a: DataFrame, b: DataFrame, parts: int = PARTS) -> DataFrame:
    """Rows on one side only, repeated rows counted; empty if the tables are equal.

    Parts with the same fingerprints are equal (126 bits of sums and the count), so only rows of other parts are compared.
    """
    b = b.select(*[F.col(f"`{c}`") for c in a.columns])
    x, y = (fingerprints(df, parts).select("part", F.struct("n", "a", "b").alias(s)) for df, s in ((a, "x"), (b, "y")))
    apart = materialise(x.join(y, "part", "full_outer").where("not (x <=> y)").select(F.col("part").alias("tf_apart")), "apart")

    def rest(df: DataFrame) -> DataFrame:
        told = [F.col(f"`{c}`").isNull() for c in df.columns]
        part = F.pmod(F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in df.columns], *told), F.lit(parts))
        return df.withColumn("tf_part", part).join(F.broadcast(apart), F.col("tf_part") == F.col("tf_apart"), "left_semi").drop("tf_part")  # at most ``parts`` rows

    left, right = rest(a), rest(b)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
