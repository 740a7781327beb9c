"""Reports of requests: results with their evidence, the context and the document of a proposal, and what a deletion changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text

# Labels of capability statuses, sections of a proposal, its table's head, the text for no risk.
LABELS = {"SUPPORTED": "支持", "PARTIALLY_SUPPORTED": "部分支持", "UNSUPPORTED": "不支持", "ENTERPRISE_ONLY": "仅企业版支持", "REQUIRES_CUSTOMIZATION": "需要定制", "NEED_REVIEW": "待确认"}
SUMMARY, MATRIX = ("方案摘要", "executive_summary"), "需求响应矩阵"
SECTIONS = (("技术方案", "technical_solution"), ("安全与合规", "security_compliance"), ("服务级别", "sla"), ("部署方案", "deployment"), ("风险与差距", "risks_and_gaps"), ("商务说明", "commercial_notes"))
HEAD = "| 需求 | 支持情况 | 回复 | 证据摘要 | 风险与差距 |\n|---|---|---|---|---|"
NO_RISK = "未识别出风险或差距"
# Statuses of runs that a deletion ends.
OPEN_RUNS = ("PENDING", "RUNNING", "WAITING_REVIEW")


def capabilities(results: DataFrame, requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """``results`` (result_id, requirement_id, ...) with the key and text of their requirement and an array ``evidence``, in order of rank.

    ``requirements``: requirement_id, requirement_key, requirement_text; ``evidence``: result_id, rank, ... Results of unknown requirements go;
    those without evidence have an empty array. An array holds what one retrieval gave.
    """
    rest = [c for c in evidence.columns if c not in ("result_id", "rank")]
    item = F.struct("rank", *rest)
    lists = evidence.groupBy("result_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    none = F.array().cast(lists.schema["evidence"].dataType)
    rows = results.join(requirements.select("requirement_id", "requirement_key", "requirement_text"), "requirement_id").join(lists, "result_id", "left")
    return rows.withColumn("evidence", F.coalesce("evidence", none))


def context(results: DataFrame, evidence: DataFrame, most: int = 3, cfg: Settings = DEFAULTS) -> DataFrame:
    """``results`` (result_id, ...) with the ``evidence`` a proposal is written from: the ``most`` first of the selected items, or of all where none is selected.

    ``evidence``: result_id, point_id, rank, is_selected, selection_order, title, filename, snippet, score. The order is that of selection, else (null or 0)
    the rank; a null or empty title gives way to the file name; snippets are cut. Only rows near the top of a result leave their task.
    """
    place = F.coalesce(F.nullif(F.col("selection_order"), F.lit(0)), F.col("rank"))
    rows = evidence.withColumn("picked", F.coalesce("is_selected", F.lit(False))).withColumn("place", place)
    best = Window.partitionBy("result_id").orderBy(F.desc("picked"), "place", "rank", "point_id")
    rows = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    # The first row is a selected one if there is any.
    rows = rows.withColumn("any", F.max("picked").over(Window.partitionBy("result_id"))).where(F.col("picked") == F.col("any"))
    item = F.struct("n", "point_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename")).alias("title"), F.substring("snippet", 1, cfg.evidence_chars).alias("snippet"), F.col("score").cast("double").alias("score"))
    lists = rows.groupBy("result_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    none = F.array().cast(lists.schema["evidence"].dataType)
    return results.join(lists, "result_id", "left").withColumn("evidence", F.coalesce("evidence", none))


def proposals(drafts: DataFrame, responses: DataFrame) -> DataFrame:
    """(rfp_id, markdown): ``drafts`` (rfp_id, title, executive_summary and the columns of ``SECTIONS``) with a table of their ``responses``.

    ``responses``: rfp_id, position, requirement_key, requirement, capability_status, response, evidence_summary, risk_or_gap. Null texts count as empty;
    an unknown status stands as it is; a draft without responses has the table's head alone.
    """
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    full = lambda c: F.coalesce(F.col(c), F.lit(""))
    cells = [
        F.concat(full("requirement_key"), F.lit(": "), full("requirement")),
        F.coalesce(F.try_element_at(labels, F.col("capability_status")), full("capability_status")),
        full("response"),
        full("evidence_summary"),
        F.coalesce(F.nullif(F.col("risk_or_gap"), F.lit("")), F.lit(NO_RISK)),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[text.markdown_cell(c) for c in cells]), F.lit(" |"))
    lines = responses.select("rfp_id", "position", line.alias("line")).groupBy("rfp_id").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("lines"))
    table = F.concat_ws("\n", F.lit(HEAD), F.transform("lines", lambda x: x["line"]))
    section = lambda name, c: F.concat(F.lit(f"## {name}\n\n"), text.strip(full(c)))
    parts = [F.concat(F.lit("# "), full("title")), section(*SUMMARY), F.concat(F.lit(f"## {MATRIX}\n\n"), table), *[section(*s) for s in SECTIONS]]
    return drafts.join(lines, "rfp_id", "left").select("rfp_id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("markdown"))


def deletion(rfps: DataFrame, runs: DataFrame, outbox: DataFrame, gone: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after the requests in ``gone`` (rfp_id) are deleted; those deleted before, and unknown ids, change nothing.

    ``rfps``: rfp_id, status, current_stage, deleted_at, completed_at: archived. ``runs``: rfp_id, status, completed_at, ...: open ones are cancelled.
    ``outbox``: event_key, status, last_error, ...: pending events fail.
    """
    at = F.lit(now)
    alive = rfps.where("deleted_at is null").select("rfp_id").distinct().join(gone.select("rfp_id").distinct(), "rfp_id", "left_semi").withColumn("__hit", F.lit(True))

    def change(rows: DataFrame, key: str, when, **values) -> DataFrame:
        hit = rows.join(alive.withColumnRenamed("rfp_id", "__id"), F.col(key) == F.col("__id"), "left")
        put = F.coalesce(F.col("__hit") & when, F.lit(False))
        return hit.select(*[F.when(put, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])

    return (
        change(rfps, "rfp_id", F.col("deleted_at").isNull(), status=F.lit("ARCHIVED"), current_stage=F.lit("deleted"), deleted_at=at, completed_at=at),
        change(runs, "rfp_id", F.col("status").isin(*OPEN_RUNS), status=F.lit("CANCELLED"), completed_at=at),
        change(outbox, "event_key", F.col("status") == "PENDING", status=F.lit("FAILED"), last_error=F.lit("RFP_DELETED")),
    )


def locations(nodes: DataFrame) -> DataFrame:
    """The location of each group of ``nodes`` (group_id, position, start, end, block_ids, bboxes): first start, last end, each block id once in order, all boxes in order."""
    item = F.struct("position", "block_ids", "bboxes")
    rows = nodes.groupBy("group_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(item)).alias("n"))
    flat = lambda name: F.flatten(F.transform("n", lambda x: x[name]))
    return rows.select("group_id", "start", "end", F.array_distinct(flat("block_ids")).alias("block_ids"), flat("bboxes").alias("bboxes"))
