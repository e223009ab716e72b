"""Monthly department report and the analysis that feeds it (JOIN-4, WIN-2, SCL-5/6/8, SNK-1 data).

Plan shape (per period; 'period' is the ``month`` column, so one month and
"all months" are the same code):

* ``conv_stats``: one shuffle on the conversation keys after a map-side partial
  aggregate; active days are kept as a day-of-month bit set (``bit_or``), so the
  department's active days are the OR of its conversations' sets — no second
  scan of the messages and no distinct-count shuffle.
* prompt cube: user prompts are tagged in the scan stage (narrow), then
  reduced map-side to (department, topic, purpose) -> (n, words) before the
  shuffle, so only a few rows per task leave the map side however large or
  skewed a department is. The cube is then summed per label, and a department's
  labels (a row each, as many as the rule sets have) become the share strings.
* the two per-department tables are joined on (month, department); both are
  bounded by departments x months, and AQE turns these joins into broadcasts at
  run time from measured sizes.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kpi import kpi_ladder_sql, per_head_score
from ..functions.rules import RuleSet, default_topic_rules, purpose_rules
from ..functions.timefn import month_label
from ..operators.distribution import lines_sql
from ..operators.enrich import enrich_prompts, with_role_flags
from ..operators.metrics import by_department, by_department_topic, conversation_stats, overview
from ..operators.override import apply_department_map, staff_table, with_staff
from ..operators.period import filter_month
from ..schema import REPORT_COLUMNS
from ..session import checkpoint_dir

PERIOD = ("month",)


def prompt_cube(prompts: DataFrame, period_cols=PERIOD) -> DataFrame:
    """(period, department, topic, purpose) -> n prompts, summed words."""
    return prompts.groupBy(*period_cols, "department", "topic", "purpose").agg(
        F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))


def department_metrics(conv_stats: DataFrame, prompts: DataFrame, period_cols=PERIOD) -> DataFrame:
    """Per (period, department): AGG-5a..f and both distribution strings.

    Active days are the OR of the conversations' day-of-month sets (same rows as
    the conversation metrics: no second scan of the messages).
    """
    keys = list(period_cols) + ["department"]
    conv_part = (conv_stats.where(F.col("department").isNotNull()).groupBy(*keys).agg(
        F.count_distinct("conversation_id").alias("conversations"),
        F.avg("user_prompts").alias("avg_prompts_per_conversation"),
        F.bit_count(F.bit_or("day_mask")).cast("long").alias("active_days")))
    cube = prompt_cube(prompts.where(F.col("department").isNotNull()), period_cols)
    # A row per label of either kind, counted before the labels of a department come together.
    labels = cube.select(*keys, "n", "words", F.explode(F.array(
        F.struct(F.lit("t").alias("kind"), F.col("topic").alias("label")),
        F.struct(F.lit("p").alias("kind"), F.col("purpose").alias("label")))).alias("x")).groupBy(
        *keys, F.col("x.kind").alias("kind"), F.col("x.label").alias("label")).agg(
        F.sum("n").alias("n"), F.sum("words").alias("words"))
    pair = F.struct((-F.col("n")).alias("k"), F.col("label").alias("l"))
    of = lambda kind, c: F.when(F.col("kind") == kind, c)
    prompt_part = labels.groupBy(*keys).agg(
        F.sum(of("t", F.col("n"))).alias("prompts"), F.sum(of("t", F.col("words"))).alias("_words"),
        F.count(of("t", F.lit(1))).alias("unique_topics"),
        F.collect_list(of("p", pair)).alias("_p"), F.collect_list(of("t", pair)).alias("_t")).select(
        *keys, "prompts", "_words", "unique_topics", F.expr(lines_sql("_p", "prompts")).alias("purpose_distribution"),
        F.expr(lines_sql("_t", "prompts")).alias("topic_distribution"))
    out = conv_part.join(prompt_part, keys, "left")
    return out.select(
        *keys,
        "conversations",
        "avg_prompts_per_conversation",
        "active_days",
        F.coalesce(F.col("prompts"), F.lit(0)).cast("long").alias("prompts"),
        F.when(F.col("prompts") > 0, F.col("_words").cast("double") / F.col("prompts").cast("double"))
        .otherwise(F.lit(0.0)).alias("avg_words_per_prompt"),
        F.coalesce(F.col("unique_topics"), F.lit(0)).cast("long").alias("unique_topics"),
        F.coalesce(F.col("purpose_distribution"), F.lit("")).alias("purpose_distribution"),
        F.coalesce(F.col("topic_distribution"), F.lit("")).alias("topic_distribution"),
    )


def with_kpi(metrics: DataFrame, staff: DataFrame | None) -> DataFrame:
    """Rating, raw score, staff and per-head KPI score (SCL-5, SCL-6, JOIN-3)."""
    rating, raw = kpi_ladder_sql()
    out = metrics.withColumns({"rating": F.expr(rating), "raw_score": F.expr(raw)})
    out = with_staff(out, staff)
    return out.withColumn("kpi_score", per_head_score(F.col("raw_score"), F.col("staff")))


def report_from_metrics(kpi: DataFrame, period_cols=PERIOD) -> DataFrame:
    """SNK-1 rows: ordinal by code-point department order within the period (WIN-2, SRT-1)."""
    w = Window.partitionBy(*period_cols).orderBy(F.col("department").asc())
    out = kpi.withColumn("ordinal", F.row_number().over(w).cast("long")).withColumn(
        "month_label", month_label(F.col("month")))
    return out.select(*REPORT_COLUMNS)


@dataclass
class Analysis:
    """The whole monthly analysis, lazily: every attribute is a DataFrame plan.

    ``messages`` is the typed message table (bridge, export ingest or landing
    table). With ``year``/``month`` set, everything is restricted to that local
    month; without, every month is reported side by side.
    """

    messages: DataFrame
    year: int | None = None
    month: int | None = None
    topic_rules: RuleSet | DataFrame = field(default_factory=default_topic_rules)  # or a table (rank, label, keyword)
    purpose: RuleSet = field(default_factory=purpose_rules)
    department_map: DataFrame | None = None
    staff: object = None
    duplicates: str = "multiply"

    def __post_init__(self):
        df = self.messages
        if (self.year is None) != (self.month is None):
            raise ValueError("give year and month, or neither for all months")
        if self.year is not None:
            df = filter_month(df, self.year, self.month)
        else:
            df = df.where(F.col("month").isNotNull())
        if self.department_map is not None:
            df = apply_department_map(df, self.department_map, self.duplicates)
        self.month_df = with_role_flags(df)
        self.conv_stats = conversation_stats(self.month_df, PERIOD)
        self.prompts = enrich_prompts(self.month_df, self.topic_rules, self.purpose)

    @property
    def spark(self) -> SparkSession:
        return self.messages.sparkSession

    def materialize(self, path: str | None = None) -> "Analysis":
        """Write the period's messages and tagged prompts once and continue from those tables.

        For several outputs of one period (overview, report, views, clustering): every later
        output reads the written tables instead of re-scanning the source and re-tagging, and
        their lineage starts there (survives executor loss without recomputing the ingest).
        Default location: a fresh folder under ``spark.checkpoint.dir`` (shared storage).
        """
        base = path or f"{checkpoint_dir(self.spark).rstrip('/')}/chatlens-analysis-{uuid.uuid4().hex}"
        self.month_df = self._kept(self.month_df, f"{base}/month")
        self.conv_stats = conversation_stats(self.month_df, PERIOD)
        # Tagged from the written messages: the source is parsed once.
        self.prompts = self._kept(enrich_prompts(self.month_df, self.topic_rules, self.purpose), f"{base}/prompts")
        self.materialized_at = base
        return self

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def departments(self) -> DataFrame:
        """FIL-8: the period's distinct non-null departments in code-point order."""
        return (self.month_df.where(F.col("department").isNotNull()).select(*PERIOD, "department").distinct()
                .orderBy(*PERIOD, "department"))

    def overview(self) -> DataFrame:
        return overview(self.conv_stats)

    def by_department(self) -> DataFrame:
        return by_department(self.conv_stats, PERIOD)

    def by_department_topic(self) -> DataFrame:
        return by_department_topic(self.prompts, PERIOD)

    def department_metrics(self) -> DataFrame:
        return department_metrics(self.conv_stats, self.prompts, PERIOD)

    def kpi(self) -> DataFrame:
        return with_kpi(self.department_metrics(), staff_table(self.spark, self.staff))

    def report(self) -> DataFrame:
        return report_from_metrics(self.kpi(), PERIOD)

    def kpi_table(self) -> DataFrame:
        """PRJ-6: department, rating and KPI score from the report."""
        return self.report().select("department", "rating", "kpi_score")
