"""Chat formatting with quotation linking.

A message's lines carry a quote level, the number of leading ``>``.  Runs of
lines of one level are passages; a passage's hash, after folding case and white
space, is joined to the hashes of what messages say themselves.  A message
replies to the source of what it quotes at the first level, and a conversation
is put in order of replies: the messages under one root together, in turn.

What messages say is reduced to one row for each hash before the join: the
first place of it in each conversation, and the first of all.  So a text that
very many messages share meets no key more than once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import written

_MARK = re.compile(r"[ \t]*>")
_INTRO = re.compile(r"\A[ \t]*(?:On .+ wrote|.+ (?:wrote|said)|Le .+ a écrit|Am .+ schrieb.*|El .+ escribió)[ \t]*:[ \t]*\Z")


def quote_level(line: str) -> tuple[int, str]:
    """The number of leading quote marks and the rest of the line."""
    level, at = 0, 0
    while m := _MARK.match(line, at):
        level, at = level + 1, m.end()
    return level, line[at:].removeprefix(" ") if level else line


def normalised(text: str) -> str:
    """Case and white space folded."""
    return " ".join(text.lower().split())


def _hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest()


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """What a message says itself, and its quoted passages as (level, text).

    A line that only introduces a quotation goes with it.  Own text keeps its
    lines; blank lines at either end, and all but one between, go.
    """
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").split("\n"):
        level, rest = quote_level(line)
        if level:
            if not before:
                k = len(own)
                while k and not own[k - 1].strip():
                    k -= 1
                if k and _INTRO.match(own[k - 1]):
                    del own[k - 1 :]
            if level != before:
                passages.append((level, []))
            passages[-1][1].append(rest)
        elif line.strip() or (own and own[-1].strip()):
            own.append(line)
        before = level
    return "\n".join(own).strip("\n"), [(n, "\n".join(p)) for n, p in passages if normalised("\n".join(p))]


def pieces(text: str) -> list[str]:
    """The text as a whole, then its blocks between blank lines, then its lines; each normalised, once."""
    blocks = re.split(r"\n[ \t]*\n", text)
    return list(dict.fromkeys(x for x in map(normalised, [text, *blocks, *text.split("\n")]) if x))


_PARSED = "conv_id {0}, turn {1}, role string, body string, n_quotes int, quotes array<struct<passage:int,level:int,rank:int,h:binary>>, own array<binary>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.list_(pa.struct([("passage", pa.int32()), ("level", pa.int32()), ("rank", pa.int32()), ("h", pa.binary())]))
    for batch in batches:
        found = [parse(t) for t in batch.column("text").to_pylist()]
        quotes = [[{"passage": k, "level": n, "rank": r, "h": _hash(x)} for k, (n, p) in enumerate(q) for r, x in enumerate(pieces(p))] for _, q in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("turn"),
                batch.column("role"),
                pa.array([b for b, _ in found], pa.string()),
                pa.array([len(q) for _, q in found], pa.int32()),
                pa.array(quotes, quote),
                pa.array([[_hash(x) for x in pieces(b)] for b, _ in found], pa.list_(pa.binary())),
            ],
            names=["conv_id", "turn", "role", "body", "n_quotes", "quotes", "own"],
        )


def chat(role: Column, body: Column) -> Column:
    """One message in chat form."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), body, F.lit("\n<|end|>\n"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """Per row of messages (conv_id, turn, role, text): conv_id, turn, role, body, chat, n_quotes, n_linked, reply_conv, reply_turn, root_turn, depth.

    A passage's source is the earliest message that says it: one of its own
    conversation with a lower turn, else the first by (conv_id, turn) of all
    others that is not of this conversation.  A passage that nothing says as a
    whole may be found by a block or a line of it, the first that is.  reply_*
    is the source of the first-level passage with the latest source; root_turn
    and depth follow replies within the conversation.  Rows are sorted by
    conversation, root and turn, which puts an answer after what it answers.

    A null text says and quotes nothing; a null role is ``unknown`` in chat
    form; a message without a conv_id or turn is nobody's source and links to
    nothing.  Rows that repeat (conv_id, turn) stay and share their links.
    """
    types = {f.name: f.dataType.simpleString() for f in messages.schema}
    rows = messages.select("conv_id", "turn", "role", "text")
    parsed = written(rows.mapInArrow(_parse, _PARSED.format(types["conv_id"], types["turn"])), "messages")
    keyed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    asked = keyed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    wanted = asked.select("h").distinct()
    own = keyed.select("conv_id", "turn", F.explode("own").alias("h")).join(wanted, "h", "left_semi")
    here = own.groupBy("conv_id", "h").agg(F.min("turn").alias("at"))
    first = F.struct("conv_id", "at")
    anywhere = here.groupBy("h").agg(F.min(first).alias("first"))
    second = here.join(anywhere, "h").where("conv_id <> first.conv_id").groupBy("h").agg(F.min(first).alias("second"))
    found = asked.join(here, ["conv_id", "h"], "left").join(anywhere, "h", "left").join(second, "h", "left")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    source = F.when(F.col("at") < F.col("turn"), F.struct("conv_id", "at")).otherwise(other)
    found = found.withColumn("source", source).where("source IS NOT NULL")
    passages = found.groupBy("conv_id", "turn", "passage", "level").agg(F.min_by("source", "rank").alias("source"))
    near = F.when(F.col("level") == 1, F.struct((F.col("source.conv_id") == F.col("conv_id")).alias("same"), F.col("source.at").alias("at"), F.col("source.conv_id").alias("conv")))
    links = passages.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(near).alias("reply"))
    links = written(links.select("conv_id", "turn", "n_linked", F.col("reply.conv").alias("reply_conv"), F.col("reply.at").alias("reply_turn")), "quote-links")

    # roots by pointer jumping over replies within a conversation: as many rounds as the depth has bits
    jumps = links.where("reply_conv = conv_id").select("conv_id", "turn", F.col("reply_turn").alias("root"), F.lit(1).cast("bigint").alias("depth"))
    moved = not jumps.isEmpty()
    while moved:
        up = jumps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = jumps.join(up, ["conv_id", "root"], "left")
        jumps = written(step.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not jumps.where("moved").isEmpty()
        jumps = jumps.drop("moved")
    out = parsed.join(links, ["conv_id", "turn"], "left").join(jumps, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "body",
        chat(F.col("role"), F.col("body")).alias("chat"),
        "n_quotes",
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        "reply_conv",
        "reply_turn",
        F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"),
    ).orderBy("conv_id", "root_turn", "turn")
