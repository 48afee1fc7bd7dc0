"""Quotation linking (operator 9, native): from quoting messages to reply-ordered conversations without quotes.

Each line's quote level is its number of leading '>' marks. A passage is a stretch of consecutive lines of one level (lines
without a letter or digit, as between paragraphs, don't end it), and each of its lines is a passage, too. Passages, with
their marks off, in lower case, punctuation and white space folded, are hashed; quoted ones are joined, within their
conversation, to the earliest message that has the same passage unquoted; only an earlier turn counts. A line of a
passage that is found as a whole goes to that message, any other line to the one that its own words lead to. Originals are
reduced to one row a passage and
quotes to one row a passage and message before the join, so a line that everybody quotes makes no pairs. A message
replies to the original of its outermost quotes (lowest level, most lines, latest turn). Roots and depths of the
reply trees come from pointer doubling, one written table a round. A parent's turn is below its child's, so (thread,
turn) is a reply order, in which the conversations come out.

Defined cases: a null text stays null and quotes nothing; rows with a null conversation or turn, and messages without a
quote that is found, are threads of their own; rows that repeat conversation and turn are one message for linking and stay
rows; columns named like a result are replaced, others pass through; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, without

RESULTS = ("reply_text", "parent_turn", "thread_turn", "depth", "n_quoted", "n_linked")
QUOTE = r"^(?:[ \t]*>)+"
#: Fixed forms of the line that mail programs put above a quote.
ATTRIBUTION = r"^(?:On|Am|Le|El)\b.*(?:wrote|schrieb.*|a écrit ?|escribió):[ \t]*$"


def folded(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def message_lines(messages: DataFrame, text: str) -> DataFrame:
    """conv_id, turn, level, the line (passage and proof, two hashes) and the stretch it stands in (whole) of each line that
    has a letter or digit."""
    named = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.monotonically_increasing_id().alias("message"), F.posexplode(F.split(F.col(f"`{text}`"), "\r?\n")).alias("place", "line"))
    mark = F.regexp_extract("line", QUOTE, 0)
    level = F.length(F.regexp_replace(mark, r"[^>]", ""))
    own = named.select("conv_id", "turn", "message", "place", level.alias("level"), folded(F.substr("line", F.length(mark) + 1)).alias("bare")).where("bare <> ''")
    hashed = own.select("conv_id", "turn", "message", "place", "level", F.xxhash64("bare").alias("passage"), F.crc32(F.col("bare").cast("binary")).alias("proof"))
    order = Window.partitionBy("conv_id", "turn", "message").orderBy("place")  # the lines of one message
    changed = F.when(F.lag("level").over(order) == F.col("level"), 0).otherwise(1)
    stretch = hashed.withColumn("changed", changed).withColumn("stretch", F.sum("changed").over(order))
    key = ["conv_id", "turn", "message", "stretch"]
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "passage", "proof"))), lambda x: F.struct(x["passage"], x["proof"]))
    whole = stretch.groupBy(*key).agg(F.first("level").alias("level"), lines.alias("lines"))
    return whole.select("conv_id", "turn", "level", F.xxhash64("lines").alias("whole"), F.inline("lines").alias("passage", "proof"))


def reply_links(messages: DataFrame, text: str = "text") -> DataFrame:
    """conv_id, turn, parent_turn (null: not found), n_quoted and n_linked lines of each message that quotes."""
    lines = message_lines(messages, text)
    own, quoted = lines.where("level = 0"), lines.where("level > 0")
    key = ["conv_id", "passage", "proof"]
    by_line = own.groupBy(*key).agg(F.min("turn").alias("by_line"))
    by_whole = own.groupBy("conv_id", "whole").agg(F.min("turn").alias("by_whole"))
    quotes = quoted.groupBy(*key, "turn", "whole").agg(F.min("level").alias("level"))
    earlier = lambda c: F.when(F.col(c) < F.col("turn"), F.col(c))
    found = quotes.join(by_line, key, "left").join(by_whole, ["conv_id", "whole"], "left").withColumn("original", F.coalesce(earlier("by_whole"), earlier("by_line")))
    once = found.groupBy(*key, "turn").agg(F.min(F.struct(F.col("original").isNull().alias("lost"), "level", "original")).alias("x")).select("conv_id", "turn", "x.level", "x.original")
    by = once.groupBy("conv_id", "turn", "original").agg(F.min("level").alias("level"), F.count("*").alias("n"))
    best = F.min(F.when(F.col("original").isNotNull(), F.struct("level", (-F.col("n")).alias("n"), (-F.col("original")).alias("o"))))
    return by.groupBy("conv_id", "turn").agg((-best["o"]).alias("parent_turn"), F.sum("n").alias("n_quoted"), F.coalesce(F.sum(F.when(F.col("original").isNotNull(), F.col("n"))), F.lit(0)).alias("n_linked"))


def thread_roots(links: DataFrame) -> DataFrame:
    """links (conv_id, turn, parent_turn) -> conv_id, turn, thread_turn and depth, by pointer doubling."""
    now = materialize(links.where("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "up")
    while True:
        above = now.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        step = now.join(above, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_t")), "left")
        step = step.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_t").isNotNull().alias("moved"))
        step = materialize(step, "up")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now.withColumnRenamed("up", "thread_turn")


def threads(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with reply_text (no quotes), parent_turn, thread_turn, depth, n_quoted and n_linked."""
    messages = without(messages, *RESULTS)
    links = materialize(reply_links(messages, text), "replies")
    joined = links.join(thread_roots(links), ["conv_id", "turn"], "left") if not links.where("parent_turn is not null").isEmpty() else links.withColumns({"thread_turn": F.lit(None).cast("long"), "depth": F.lit(None).cast("long")})
    joined = joined.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "parent_turn", "thread_turn", "depth", "n_quoted", "n_linked")
    own = F.filter(F.split(F.col(f"`{text}`"), "\r?\n"), lambda line: ~line.rlike(QUOTE) & ~line.rlike(ATTRIBUTION))
    out = messages.join(joined, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")
    return out.withColumns({
        "reply_text": F.trim(F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")),
        "thread_turn": F.coalesce("thread_turn", "turn"),
        **{c: F.coalesce(c, F.lit(0)).cast("long") for c in ("depth", "n_quoted", "n_linked")},
    })


def as_conversations(threaded: DataFrame) -> DataFrame:
    """Rows in reply order, range-partitioned: each thread's messages stand together, parents first."""
    return threaded.repartitionByRange("conv_id", "thread_turn", "turn").sortWithinPartitions("conv_id", "thread_turn", "turn")
