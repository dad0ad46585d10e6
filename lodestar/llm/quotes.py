"""Chat formatting by quotation linking.

Every message is split into runs of lines with one quote level (the ``>`` signs at the line's start).
A quoted run is a passage; its text without the signs is normalised (lower case, words joined by
one space) and hashed. What a message says itself is hashed as well: its whole own text, every run, every
line, and every sentence, within a line and across line breaks. A passage is taken whole, as the sentences of its lines, and
as its sentences whatever the line breaks; it is linked to the earliest earlier message of its conversation that says
all parts of one of these, so a trimmed or re-wrapped quote is found. Messages then form threads: a message answers the message that its first linked passage of the lowest level comes from, and a
conversation is given thread by thread in the order of the messages, without quotes.

All steps are built-in functions: the originals of a key are reduced to the earliest message before
they meet the quotes, so a line that everybody quotes joins one row per conversation; a passage of several parts
meets only the messages that say its rarest part, once for all that quote it; roots come from pointer jumping. No conversation is ever gathered into one row.

Defined results: null text is empty; turns tied within a conversation are ordered by role, then text; a message
of quotes alone has an empty text; a passage that no earlier message says stays unlinked, as does a re-wrapped one that
starts or ends inside a sentence; a passage may leave out sentences or lines of its source; nested levels are
passages of their own; rows without conv_id or turn are kept, are not linked and are roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import table


#: A sentence ends with these signs and white space, or with the full-width ones.
SENTENCE = r"(?<=[.!?…][\"'”’»)\]]{0,3})\s+|(?<=[。！？])"


def _normal(c):
    return F.trim(F.regexp_replace(F.lower(c), r"[\s\p{P}\p{S}]+", " "))


def _lines(text):
    """Lines as (level, body): the quote signs at the start, and what follows."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, r"^((?:\s?>)*)", 1), r"\s", "")).alias("level"),
        F.regexp_replace(x, r"^(?:\s?>)+ ?", "").alias("body")))


def _runs(lines):
    """Consecutive lines of one level as (level, body)."""
    return F.aggregate(
        lines, F.array().cast("array<struct<level:int,body:string>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["level"] == x["level"]), F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(x["level"].alias("level"), F.concat(F.element_at(acc, -1)["body"], F.lit("\n"), x["body"]).alias("body")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["level"].alias("level"), x["body"].alias("body"))))))


def _sentences(text):
    return F.split(text, SENTENCE)


def _joined(body):
    """The sentences of a text whatever its line breaks."""
    return _sentences(F.regexp_replace(body, r"\s+", " "))


def _by_line(body):
    """The sentences of each line."""
    return F.flatten(F.transform(F.split(body, "\n"), _sentences))


def _parts(texts):
    """Distinct normalised texts that hold a word, in a fixed order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(texts, _normal), lambda x: x != "")))


def parse(messages: DataFrame) -> DataFrame:
    """msg (a row number), conv_id, turn, role, own text without quotes, and runs by quote level."""
    m = messages.select("conv_id", "turn", "role", "text").withColumn("msg", F.monotonically_increasing_id())
    m = m.withColumn("runs", _runs(_lines(F.col("text"))))
    own = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"]), "\n")
    return m.withColumn("own", F.regexp_replace(own, r"^\s+|\s+$", ""))


def link(messages: DataFrame) -> DataFrame:
    """Every message with the message it answers (``parent``) and the number of linked passages."""
    m = table(parse(messages), "messages")
    place = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "msg")
    keyed = m.where("conv_id is not null and turn is not null").withColumn("place", place)
    quoted = keyed.select("conv_id", "msg", F.posexplode("runs").alias("at", "run")).where("run.level > 0")
    body = F.col("run.body")
    ways = F.array_distinct(F.array(_parts(F.array(body)), _parts(_by_line(body)), _parts(_joined(body))))
    ways = table(quoted.select("conv_id", "msg", F.struct("run.level", "at").alias("at"), F.explode(ways).alias("parts"))
                 .where(F.size("parts") > 0), "passages")
    wanted = table(ways.select("conv_id", "parts").distinct().withColumn("want", F.monotonically_increasing_id()), "wanted")
    part = wanted.select("conv_id", "want", F.size("parts").alias("n"), F.explode("parts").alias("said")).withColumn("key", F.xxhash64("said"))
    own = F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["body"])
    texts = F.concat(F.array(F.col("own")), own, F.split("own", "\n"), _by_line(F.col("own")), _joined(F.col("own")),
                     F.flatten(F.transform(own, _joined)))
    says = keyed.select("conv_id", "msg", F.explode(_parts(texts)).alias("said")).withColumn("key", F.xxhash64("said"))
    says = table(says.join(part.select("conv_id", "key", "said").distinct(), ["conv_id", "key", "said"], "left_semi"), "says")
    often = says.groupBy("conv_id", "key", "said").agg(F.count(F.lit(1)).alias("often"))
    part = table(part.join(often, ["conv_id", "key", "said"]), "parts")
    # a message that says all parts of a passage says the one that the fewest messages say
    lead = part.groupBy("conv_id", "want", "n").agg(
        F.count(F.lit(1)).alias("found"), F.min_by(F.struct("key", "said"), F.struct("often", "key", "said")).alias("lead")).where("found = n")
    near = lead.select("conv_id", "want", "n", "lead.key", "lead.said").join(says, ["conv_id", "key", "said"]).select("want", "n", "msg")
    several = (near.where("n > 1").join(part.select("conv_id", "want", "key", "said"), "want").join(says, ["conv_id", "key", "said", "msg"])
               .groupBy("want", "n", "msg").agg(F.count(F.lit(1)).alias("found")).where("found = n").select("want", "msg"))
    first = (near.where("n = 1").select("want", "msg").union(several).join(keyed.select("msg", "place"), "msg")
             .groupBy("want").agg(F.min("place").alias("source")))
    source = wanted.join(first, "want").select("conv_id", "parts", "source")
    linked = ways.join(source, ["conv_id", "parts"]).groupBy("msg", "at").agg(F.min("source").alias("source"))
    linked = linked.join(keyed.select("msg", "place"), "msg").where("source < place")
    parent = linked.groupBy("msg").agg(F.min_by(F.col("source.msg"), "at").alias("parent"), F.count(F.lit(1)).alias("n_links"))
    return m.join(parent, "msg", "left")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message once: conv_id, turn, role, text without quotes, reply_to (turn), root (turn of its
    thread's first message), depth in the thread, n_links; read in the order root, turn."""
    m = table(link(messages), "linked")
    chain = m.where("parent is not null").select("msg", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    chain = table(chain, "chain")
    while True:  # pointer jumping: as many rounds as the logarithm of the deepest thread
        above = chain.select(F.col("msg").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = table(chain.join(above, "up", "left").select(
            "msg", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved")), "chain")
        chain = step.drop("moved")
        if step.where("moved").limit(1).count() == 0:
            break
    turn = m.select(F.col("msg").alias("id"), F.col("turn").alias("t"))
    out = m.join(chain, "msg", "left")
    out = out.join(turn.select(F.col("id").alias("parent"), F.col("t").alias("reply_to")), "parent", "left")
    out = out.join(turn.select(F.col("id").alias("up"), F.col("t").alias("up_turn")), "up", "left")
    shown = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("own"))
    return out.select("conv_id", "turn", "role", F.col("own").alias("text"), shown.alias("formatted"), "reply_to",
                      F.coalesce("up_turn", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
