"""Routing and history of conversations: each thread is a log of turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

NO_HISTORY = "無"
#: What an intent must contain, in this order, and the agent that takes it.
INTENTS = (("ACTION", "Action Agent"), ("CLARIFY", "Clarification Agent"), ("ACADEMIC", "Academic Agent"))
FALLBACK = "Fallback Agent"
#: The node that runs each agent.
NODES = {"Action Agent": "action_node", "Clarification Agent": "clarification_node", "Academic Agent": "academic_node", "Fallback Agent": "fallback_node"}
END = "end_node"
NO_RESULT = "系統沒有回傳任何結果。"


def recent(turns: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text", n: int = 3) -> DataFrame:
    """turns with history: the last n texts of the thread, this one included, joined by ' -> '. A null text has its place
    among the n and adds nothing."""
    w = Window.partitionBy(thread).orderBy(turn).rowsBetween(1 - n, 0)
    return turns.withColumn("history", F.coalesce(F.nullif(F.array_join(F.collect_list(text).over(w), " -> "), F.lit("")), F.lit(NO_HISTORY)))


def intent_of(label: Column) -> Column:
    """The agent for a classifier's label; the first word of INTENTS that it contains decides."""
    said = F.upper(T.strip(label))
    out = F
    for word, agent in INTENTS:
        out = out.when(said.contains(word), agent)
    return out.otherwise(FALLBACK)


#: Words that ask for information, and for something to be done.
ASKS, DO_IT = "多少錢|要錢|費用|補助|怎麼|規定|期限|門檻|\\?|？", "幫我"


def keyword_intent(text: Column) -> Column:
    """A label from key words, in place of a model: asking for something to be done, for information, or too little."""
    asks = text.rlike(ASKS)
    return F.when(text.rlike(DO_IT) & ~asks, "ACTION").when(F.length(T.strip(text)) <= 4, "CLARIFY").when(asks, "ACADEMIC").otherwise("FALLBACK")


def route(turns: DataFrame, label: Column | None = None, classifier: Callable[[Column], Column] = keyword_intent, text: str = "text") -> DataFrame:
    """turns with next_agent and node."""
    agent = intent_of(label if label is not None else classifier(F.col(text)))
    return turns.withColumn("next_agent", agent).withColumn("node", node_of(F.col("next_agent")))


def node_of(agent: Column) -> Column:
    pairs = [F.lit(x) for kv in NODES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), agent), F.lit(END))


def last_state(turns: DataFrame, columns: list[str], thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Fields that each turn overwrites: their values at the last turn of every thread."""
    return turns.groupBy(thread).agg(*(F.max_by(c, turn).alias(c) for c in columns))


def appended_state(turns: DataFrame, column: str, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A field to which each turn appends: its values in order of turns."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(turn, column))), lambda x: x[column])
    return turns.groupBy(thread).agg(listed.alias(column))


def reply(results: Column, sources: Column, agent: Column) -> Column:
    """The response as JSON: the last result only."""
    return reply_with(F.try_element_at(results, F.lit(-1)), sources, agent)


def reply_with(result: Column, sources: Column, agent: Column) -> Column:
    """The response as JSON with one result; a fixed text without any."""
    last = F.coalesce(result, F.lit(NO_RESULT))
    return F.to_json(F.struct(F.lit("success").alias("status"), F.array(last).alias("response"), F.coalesce(sources, F.array().cast("array<string>")).alias("sources"),
                              F.struct(F.lit("completed").alias("current_step"), agent.alias("executed_agent")).alias("debug_info")))


def needs_clarification(turns: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """turns with clarify: whether neither this text nor the two before it name a department or degree level."""
    w = Window.partitionBy(thread).orderBy(turn).rowsBetween(-2, 0)
    return turns.withColumn("clarify", ~F.coalesce(F.bool_or(F.col(text).rlike("系|所|學士|碩士|博士|大學部")).over(w), F.lit(False)))


def append_messages(messages: DataFrame, path: str) -> None:
    """Add messages to the log table at path."""
    messages.write.mode("append").parquet(path)


def page_carry(pages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", n: int = 400) -> DataFrame:
    """pages with carry: the last n characters of the page before; '' on the first."""
    w = Window.partitionBy(key).orderBy(order)
    return pages.withColumn("carry", F.coalesce(F.right(F.lag(text).over(w), F.lit(n)), F.lit("")))


def joined_pages(order: str, text: str = "text", ocr: bool = False) -> Column:
    """The aggregate of page_concat, for use beside others of one groupBy."""
    body = F.coalesce(F.col(text), F.lit(""))
    one = F.concat(F.lit("\n"), body) if ocr else F.concat(body, F.lit("\n\n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))), lambda x: x["t"])
    return F.array_join(listed, "\n\n---\n\n" if ocr else "")


def page_concat(pages: DataFrame, key: str, order: str, text: str = "text", ocr: bool = False) -> DataFrame:
    """key, text: plain pages each followed by an empty line; OCR pages each after a line end, joined by rules."""
    return pages.groupBy(key).agg(joined_pages(order, text, ocr).alias("text"))


#: What names a department, a degree level, and the levels above every department.
DEPARTMENT, DEGREE = "(\\p{L}{2}(?:系|所))", "(學士|碩士|博士|大學部)"
GENERAL = "全校通用 大學部"


def carry_conditions(turns: DataFrame, thread: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """turns with department and degree: the last ones that the thread has named so far; a new one replaces the old."""
    w = Window.partitionBy(thread).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    named = lambda pattern: F.last(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1), F.lit("")), ignorenulls=True).over(w)
    return turns.withColumns({"department": named(DEPARTMENT), "degree": named(DEGREE)})


def expansion(turns: DataFrame, colleges: DataFrame | None = None, thread: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """turns with expanded: the question, what was asked last before it, the conditions that hold, and the terms above them;
    and with the conditions themselves: department, degree and, if known, college.

    The earlier question is carried where this turn only adds a condition, that is names a department or degree and little
    else. colleges(department, college) adds the department's college.
    """
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), DEPARTMENT, ""), DEGREE + "|那|呢|的|班", "")
    held = carry_conditions(turns, thread, turn, text)
    target = F.when(F.length(T.strip(bare(F.col(text)))) > 1, bare(F.col(text)))
    w = Window.partitionBy(thread).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("__asked", target).withColumn("__before", F.last("__asked", ignorenulls=True).over(w))
    if colleges is not None:
        held = held.join(colleges.select(F.col("department").alias("__department"), F.col("college").alias("__college")), F.col("department") == F.col("__department"), "left")
    else:
        held = held.withColumn("__college", F.lit(None).cast("string"))
    parts = F.array(F.coalesce("__asked", "__before"), F.col("department"), F.col("__college"), F.coalesce("degree", F.lit(GENERAL)))
    kept = F.array_distinct(F.filter(F.transform(parts, T.strip), lambda x: x.isNotNull() & (x != "")))
    return held.select(*turns.columns, "department", "degree", F.col("__college").alias("college"), F.array_join(kept, " ").alias("expanded"))


def response(body: Column) -> Column:
    """answer, sources of a reply as JSON: the first element of its response; defaults where something is missing."""
    read = F.from_json(body, "status string, response array<string>, sources array<string>")
    return F.struct(F.coalesce(F.get(read["response"], F.lit(0)), F.lit(NO_RESULT)).alias("answer"), F.coalesce(read["sources"], F.array().cast("array<string>")).alias("sources"))
