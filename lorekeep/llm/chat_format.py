r"""Chat formatting with typed content parts [native].

A message has a role and an ordered list of content parts (text, image, audio,
document).  A visitor turns each part into its piece of the rendered text: text
is escaped, every other part becomes a placeholder ``<|kind:i|>`` where ``i``
numbers the conversation's attachments.  The attachments are recorded beside the
text with their reference and the number of tokens the placeholder expands to.

Template of a turn: ``<turn>role\ntext</turn>\n``.  Escapes, reversible: ``\`` is
written ``\b``, ``<`` is written ``\l`` and, in roles, a line feed is written
``\n``.  So no text can hold a control string.

Defined results: null text, role or parts count as empty; a null kind is text;
an unknown kind is a placeholder of its own name with no tokens.  Rows of a conversation are
ordered by (turn, role, parts), nulls first, so ties and repeated rows have one
outcome.  Rows with a null conversation id form one conversation.  An empty
table gives no rows.  Other columns of the input are not carried.

A conversation is one output string, so the rows of one conversation meet in
one task by definition of the result; there is no bound on the number of
conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens a placeholder expands to: image tiles of 28 x 28 pixels, 25 audio
#: frames a second, 512 tokens for each page of a document.
IMAGE_TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as a list with one text part."""
    null = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in null.items()]))


def _kind(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text"))


def part_tokens(part: Column) -> Column:
    """Tokens that the placeholder of a part expands to; text parts have none."""
    tiles = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) / IMAGE_TILE)
    count = (
        F.when(_kind(part) == "image", tiles(part["width"]) * tiles(part["height"]))
        .when(_kind(part) == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE))
        .when(_kind(part) == "document", F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * PAGE_TOKENS)
        .otherwise(0)
    )
    return count.cast("long")


def format_chats(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation of ``messages`` (conv_id, turn, role, parts).

    ``formatted``: the rendered text.  ``loss_spans``: (start, length) in code points of every loss role's
    text within it, with the same in UTF-8 bytes (at, bytes).  ``attachments``: (index, turn_no,
    kind, ref, tokens) in order.  ``placeholder_tokens``: their sum.

    The parts of a conversation are laid out in order once; running sums over them number the
    attachments and place the spans, so time grows with the parts and not with their square.  All
    steps share the one exchange by conversation.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("parts", F.array().cast(PARTS)).alias("parts"))
    chats = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    turns = chats.select("conv_id", F.posexplode("rows").alias("turn_no", "row")).select("conv_id", "turn_no", "row.role", F.size("row.parts").alias("n_parts"), "row.parts")
    parts = turns.select("conv_id", "turn_no", "role", "n_parts", F.posexplode_outer("parts").alias("part_no", "part"))
    parts = parts.withColumn("part_no", F.coalesce("part_no", F.lit(0)))
    here = Window.partitionBy("conv_id").orderBy("turn_no", "part_no")
    earlier, turn = here.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id", "turn_no")
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    is_text = F.col("part").isNull() | (_kind(F.col("part")) == "text")
    parts = parts.withColumn("index", total((~is_text).cast("long"), earlier))
    body = F.when(is_text, escape(F.col("part.text"))).otherwise(F.concat(F.lit("<|"), escape(_kind(F.col("part"))), F.lit(":"), F.col("index").cast("string"), F.lit("|>")))
    head = F.when(F.col("part_no") == 0, F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit("\n"))).otherwise("")
    close = F.when(F.col("part_no") >= F.col("n_parts") - 1, F.lit(CLOSE)).otherwise("")
    parts = parts.withColumns({"body": body, "head": head, "close": close})
    units = {"chars": F.length, "bytes": F.octet_length}
    parts = parts.withColumns({f"{u}_whole": size("head") + size("body") + size("close") for u, size in units.items()} | {f"{u}_body": size("body") for u, size in units.items()})
    parts = parts.withColumns({f"{u}_at": total(f"{u}_whole", earlier) + size("head") for u, size in units.items()} | {f"{u}_n": total(f"{u}_body", turn) for u in units})
    span = F.struct(F.col("chars_at").alias("start"), F.col("chars_n").alias("length"), F.col("bytes_at").alias("at"), F.col("bytes_n").alias("bytes"))
    record = F.struct("index", "turn_no", _kind(F.col("part")).alias("kind"), F.col("part.ref").alias("ref"), part_tokens(F.col("part")).alias("tokens"))
    pieces = parts.select(
        "conv_id",
        F.struct(
            "turn_no", "part_no", F.concat("head", "body", "close").alias("text"),
            F.when((F.col("part_no") == 0) & (F.col("role") == loss_role), span).alias("span"),
            F.when(~is_text, record).alias("attachment"),
        ).alias("piece"),
    )
    done = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"), F.sum(F.coalesce("piece.attachment.tokens", F.lit(0).cast("long"))).alias("placeholder_tokens"))
    present = lambda name: F.filter(F.col(f"pieces.{name}"), lambda x: x.isNotNull())
    return done.select(
        "conv_id",
        F.array_join("pieces.text", "").alias("formatted"),
        present("span").alias("loss_spans"),
        present("attachment").alias("attachments"),
        "placeholder_tokens",
    )


def read_chat(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, r"</turn>\n", -1), lambda x: x != "")
    head = lambda x: F.instr(x, "\n")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring(x, F.lit(len(OPEN) + 1), head(x) - F.lit(len(OPEN) + 1)), role=True).alias("role"),
            unescape(F.substring(x, head(x) + 1, F.length(x))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order.

    The spans are cut out of the text's bytes, which are made once, as a code point can only be found by counting.
    """
    cut = lambda raw: F.array_join(F.transform(spans, lambda s: unescape(F.substring(raw, (s["at"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))), "")
    return F.element_at(F.transform(F.array(formatted.cast("binary")), cut), 1)


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Format all conversations and one made of control strings; digests of what is read back."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    rows = given.unionByName(trap)
    chats = format_chats(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    back = chats.withColumns({"read": read_chat(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', ''))) AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + length(role) + 6 + 1 + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
