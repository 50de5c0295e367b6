"""Chat formatting into budgeted windows, with DataFrame functions only.

A conversation becomes one or more training texts of at most ``budget`` tokens. Prefix sums of the turns'
tokens choose the spans: turns whose sums fall into the same cell of a grid form a window, so every span
follows from sums alone, with no walk along the conversation. Each later window repeats the leading system
turn and a limited history; what is repeated carries no loss.

Sums are taken in sections of a conversation and carried over by one row per section, so a conversation
with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import read_table

#: Turns per section; the largest group that is ever sorted in one task.
SECTION = 256
TARGET = "assistant"
END = "</turn>\n"
#: Control characters of the template and how they are written inside texts; read back from last to first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in (*ESCAPES, *((((":", "\\c"),)) if role else ())):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in ((":", "\\c"), *reversed(ESCAPES)):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Null-safe equality, so that rows without a conversation form one of their own."""
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def format_windows(
    turns: DataFrame, budget: int = 1024, history_tokens: int = 256, history_turns: int = 4, tokens: Column | None = None,
) -> DataFrame:
    """Windows of (conv_id, turn, role, text): conv_id, window (from 1), formatted, loss_spans, n_repeated, n_tokens.

    ``loss_spans`` are (start, end) code point offsets into ``formatted`` of assistant texts that no earlier
    window holds. The first ``n_repeated`` turns of a window repeat earlier ones. ``tokens`` is the cost of a
    turn, by default a quarter of its bytes and 4 for its marks. A turn over a quarter of the budget has a
    window of its own; only such a window can exceed the budget.

    Turns go by (turn, role, text), nulls first; rows equal in all of these all stay. Null text or role is
    empty; rows with null conv_id are one conversation. No rows give no windows. Other columns are ignored.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    cost = F.floor((F.octet_length(text) + F.lit(3)) / 4) + 4 if tokens is None else tokens
    longest = budget // 4
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), cost.cast("long").alias("cost"),
        F.coalesce(F.floor(F.col("turn") / SECTION), F.lit(-1)).alias("section"),
    )
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "cost")).alias("head")).select(
        F.col("conv_id").alias("c"), (F.col("head.role") == "system").alias("has_system"), F.col("head.text").alias("system"),
        F.when(F.col("head.role") == "system", F.col("head.cost")).otherwise(0).alias("system_cost"))
    within = Window.partitionBy("conv_id", "section").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("k", F.row_number().over(within.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    local = local.withColumns({"long": (F.col("cost") > longest).cast("long"), "fits": F.when(F.col("cost") > longest, 0).otherwise(F.col("cost"))})
    local = local.withColumns({n: F.sum(c).over(within) for n, c in (("all_sum", "cost"), ("fit_sum", "fits"), ("long_sum", "long"))})
    before = Window.partitionBy("conv_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    sections = rows.groupBy("conv_id", "section").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.sum((F.col("cost") > longest).cast("long")).alias("long"),
        F.sum(F.when(F.col("cost") > longest, 0).otherwise(F.col("cost"))).alias("fits"))
    sections = sections.select(F.col("conv_id").alias("c"), F.col("section").alias("s"), *[
        F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_0") for n in ("n", "cost", "long", "fits")])
    placed = local.join(sections, local["conv_id"].eqNullSafe(sections["c"]) & (local["section"] == sections["s"])).drop("c", "s")
    placed = placed.join(first, placed["conv_id"].eqNullSafe(first["c"])).drop("c")
    index = F.col("k") + F.col("n_0")
    lead = F.col("has_system") & (index == 1)
    skip = F.when(F.col("has_system"), F.col("system_cost")).otherwise(0)  # the system turn is paid for in every window
    short = F.when(F.col("has_system") & (F.col("system_cost") <= longest), F.col("system_cost")).otherwise(0)
    room = F.greatest(F.lit(budget - history_tokens - longest) - F.col("system_cost"), F.lit(max(1, budget // 8)))
    fit_before = F.col("fit_sum") + F.col("fits_0") - F.col("fits") - short
    long_before = F.col("long_sum") + F.col("long_0") - F.col("long") - F.when(F.col("has_system") & (F.col("system_cost") > longest), 1).otherwise(0)
    is_long = F.when(lead, 0).otherwise(F.col("long"))
    placed = placed.select(
        "conv_id", index.alias("i"), "role", "text", "cost", "has_system", "system", "system_cost", lead.alias("lead"),
        (F.col("all_sum") + F.col("cost_0") - skip).alias("upto"),
        F.when(lead, F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"))).otherwise(
            F.struct(long_before.cast("long").alias("a"), is_long.cast("long").alias("b"),
                     F.when(is_long == 1, 0).otherwise(F.floor(fit_before / room)).cast("long").alias("c"))).alias("cell"),
    )
    starts = placed.groupBy("conv_id", "cell").agg(
        F.min(F.struct("i", (F.col("upto") - F.when(F.col("lead"), 0).otherwise(F.col("cost"))).alias("at"), "has_system", "system", "system_cost")).alias("start"))
    asked = starts.select(
        "conv_id", "cell", F.col("start.at").alias("at"), F.col("start.has_system").alias("s"),
        F.explode(F.sequence(F.col("start.i") - history_turns, F.col("start.i") - 1)).alias("j"),
    ).where("j >= 1 AND NOT (s AND j = 1)")
    past = asked.join(placed.select(F.col("conv_id").alias("c"), "i", "role", "text", "cost", "upto"),
                      F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("i") == F.col("j")))
    past = past.where(F.col("at") - (F.col("upto") - F.col("cost")) <= history_tokens)
    head = starts.where("start.has_system AND start.i > 1").select(
        "conv_id", "cell", F.lit(0).alias("kind"), F.lit(1).cast("long").alias("i"), F.lit("system").alias("role"),
        F.col("start.system").alias("text"), F.col("start.system_cost").alias("cost"))
    parts = head.unionByName(past.select("conv_id", "cell", F.lit(1).alias("kind"), "i", "role", "text", "cost")).unionByName(
        placed.select("conv_id", "cell", F.lit(2).alias("kind"), "i", "role", "text", "cost"))
    opening = F.concat(F.lit("### "), escaped(F.col("role"), role=True), F.lit(": "))
    body = escaped(F.col("text"))
    parts = parts.select(
        "conv_id", "cell", "cost",
        F.struct("kind", "i", F.concat(opening, body, F.lit(END)).alias("piece"), F.length(opening).alias("skip"),
                 F.when((F.col("kind") == 2) & (F.col("role") == TARGET), F.length(body)).alias("loss")).alias("part"))
    windows = parts.groupBy("conv_id", "cell").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("cost").alias("n_tokens"))
    begin = F.lit([]).cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        "parts", F.struct(F.lit(0).alias("at"), begin.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["loss"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + p["skip"]).alias("start"), (acc["at"] + p["skip"] + p["loss"]).alias("end"))))).alias("spans")),
        lambda acc: acc["spans"])
    return windows.select(
        "conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("cell")).alias("window"),
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"),
        F.size(F.filter("parts", lambda p: p["kind"] < 2)).alias("n_repeated"), "n_tokens",
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per window what its text says: conv_id, window, turns (role, text of those not repeated), loss (texts), chars."""
    pieces = F.slice(F.split("formatted", END, -1), F.col("n_repeated") + 1, F.greatest(
        F.size(F.split("formatted", END, -1)) - 1 - F.col("n_repeated"), F.lit(0)))
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, 5, F.length(p)), ": ", 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, ": ") + 2, F.length(p))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back: digests of turns and of the text under the loss mask.

    The digest of a conversation needs its whole text in one row; all other steps work in sections and windows.
    """
    extra = spark.sql(
        r"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    windows = read_back(format_windows(turns))
    one = windows.select(
        "conv_id", "chars", F.size("turns").cast("long").alias("n"),
        F.struct("window", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
                 F.array_join("loss", "").alias("loss")).alias("w"))
    whole = one.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("w")).alias("w"))
    turns_text, loss_text = F.array_join("w.turns", ""), F.array_join("w.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(turns_text, 256).alias("turns_sha256"), F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"), "formatted_chars")


#: The same by window functions over whole conversations.
SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), a AS (
  SELECT *, (strlen(text) + 3) // 4 + 4 AS cost,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))
      + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) + 6 + 8 AS size
  FROM t
), b AS (
  SELECT *, first_value(role) OVER c = 'system' AS has_system, first_value(cost) OVER c AS first_cost, first_value(size) OVER c AS first_size
  FROM a WINDOW c AS (PARTITION BY conv_id ORDER BY i)
), d AS (
  SELECT *, has_system AND i = 1 AS lead, CASE WHEN has_system AND i = 1 THEN 0 ELSE cost END AS own, CASE WHEN has_system THEN first_cost ELSE 0 END AS sys FROM b
), e AS (
  SELECT *, coalesce(sum(CASE WHEN own <= 256 THEN own ELSE 0 END) OVER p, 0) AS fit, coalesce(sum((own > 256)::INT) OVER p, 0) AS longs, coalesce(sum(own) OVER p, 0) AS pos
  FROM d WINDOW p AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, CASE WHEN lead THEN [0, 0, 0] WHEN own > 256 THEN [longs, 1, 0] ELSE [longs, 0, fit // greatest(512 - sys, 128)] END::BIGINT[] AS cell FROM e
), w AS (
  SELECT conv_id, cell, min(i) AS i0, min(pos) AS pos0, bool_or(has_system) AS has_system, min(first_size) AS first_size FROM f GROUP BY conv_id, cell
), h AS (
  SELECT w.conv_id, sum(f.size) AS size FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i >= w.i0 - 4 AND f.i < w.i0
    AND NOT f.lead AND w.pos0 - f.pos <= 256 GROUP BY w.conv_id
), s AS (SELECT conv_id, sum(first_size) AS size FROM w WHERE has_system AND i0 > 1 GROUP BY conv_id)
SELECT f.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(f.size) + coalesce(any_value(h.size), 0) + coalesce(any_value(s.size), 0) AS BIGINT) AS formatted_chars
FROM f LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM f.conv_id
GROUP BY f.conv_id
"""
