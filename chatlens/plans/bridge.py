"""Bridge from the driver's ``conversations`` table to the message table.

``conversations`` (conv_id, turn, role, text) carries no account, title, id or
time, so they are derived deterministically from (conv_id, turn); the same
arithmetic is used by the SQL oracle. User prompts get one of fifteen
Vietnamese request phrases in front so that the keyword rules have something to
match. Pure column arithmetic: narrow, no shuffle, scales with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import sql_string
from ..schema import with_times

# Fixture design values of this repository's bridge (not behaviour constants).
BASE_EPOCH = 1704067200          # 2024-01-01 00:00:00 UTC
DAY_SPREAD = 90                  # conversations start on one of 90 days
DEPARTMENTS = 5
PROMPT_PHRASES = [
    "Viết email trả lời khách hàng",
    "Tóm tắt hợp đồng nhà thầu",
    "Dịch sang tiếng Anh",
    "So sánh hai công thức, ví dụ",
    "Lập bảng ngân sách theo định dạng JSON",
    "Bạn là kỹ sư giám sát thi công",
    "Fix code python bị bug",
    "Báo cáo doanh thu tháng",
    "Tra cứu quy định là gì",
    "Tuyển dụng ứng viên, phỏng vấn",
    "Đặt mua văn phòng phẩm",
    "Thiết kế logo",
    "Kế hoạch marketing",
    "xin chào",
    "",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bridge_raw(conversations: DataFrame) -> DataFrame:
    """conversations -> message rows with epoch seconds (before time normalisation); one projection."""
    phrases = "array(" + ", ".join(sql_string(p) for p in PROMPT_PHRASES) + ")"
    dept = f"concat('dept_', CAST(conv_id % {DEPARTMENTS} AS STRING))"
    return conversations.selectExpr(
        f"{dept} AS account",
        "concat('c', CAST(conv_id AS STRING)) AS conversation_id",
        "concat('Conversation ', CAST(conv_id AS STRING)) AS conversation_title",
        "concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS message_id",
        "role",
        "CAST(NULL AS STRING) AS author",
        f"CASE WHEN role = 'user' THEN concat(get({phrases}, CAST((conv_id * 3 + turn) % {len(PROMPT_PHRASES)} AS INT)), "
        "' ', text) ELSE text END AS text",
        f"CAST({BASE_EPOCH} + ((conv_id * 37) % {DAY_SPREAD}) * 86400 + turn * 3600 AS DOUBLE) AS epoch_seconds",
        f"{dept} AS department",
    )


def bridge_messages(conversations: DataFrame) -> DataFrame:
    """conversations -> typed message table (MESSAGE_COLUMNS)."""
    return with_times(bridge_raw(conversations))


def load_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge_messages(read_table(spark, sf_dir, "conversations"))
