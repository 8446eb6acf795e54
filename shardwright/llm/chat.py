"""Chat formatting with typed content parts (DataFrame functions only).

A turn's content is an array of typed parts. One visitor per kind turns a part
into the text that goes into the formatted conversation: text is escaped, an
image, audio clip or document becomes a placeholder mark, in order, and its
reference and the number of model tokens it expands to are recorded next to it.

Template: ``<|im_start|>role\\ncontent<|im_end|>\\n`` for each turn. Every mark
starts with ``<|``. Inside texts ``<``, any number of backslashes and ``|`` get
one backslash more, so no text contains a mark and taking one backslash away
restores it. Two text parts in a row are kept apart by ``<|sep|>``.

Defined cases: null text, role or parts count as empty; turns are taken in the
order (turn, role, content) with nulls first, so ties and repeated rows have one
result; a null ``conv_id`` is a conversation of its own; a part of unknown kind
becomes ``<|other|>`` with no tokens; an empty table gives an empty result; other
columns are ignored. A conversation is one output value, so its rows meet in one
task; nothing else is grouped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardwright.llm.common import let

START, END, SEP = "<|im_start|>", "<|im_end|>", "<|sep|>"
PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
IMAGE_PATCH, AUDIO_TOKENS_PER_S, DOCUMENT_TOKENS_PER_PAGE = 32, 25, 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """A role ends at the first line feed, so its own are written as ``%0A``."""
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A plain text as an array of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            *(F.lit(None).cast(t).alias(n) for n, t in
                              (("width", "long"), ("height", "long"), ("seconds", "double"), ("pages", "long")))))


def _patches(side: Column) -> Column:
    return F.ceil(F.coalesce(side, F.lit(1)) / F.lit(IMAGE_PATCH))


# kind -> (rendered text, expanded tokens) of a part
VISITORS: dict[str, Callable[[Column], tuple[Column, Column]]] = {
    "text": lambda p: (escape(F.coalesce(p["text"], F.lit(""))), F.lit(0).cast("long")),
    "image": lambda p: (F.lit("<|image|>"), (_patches(p["width"]) * _patches(p["height"])).cast("long")),
    "audio": lambda p: (F.lit("<|audio|>"), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS_PER_S).cast("long")),
    "document": lambda p: (F.lit("<|document|>"), (F.coalesce(p["pages"], F.lit(1)) * DOCUMENT_TOKENS_PER_PAGE).cast("long")),
}


def visit(parts: Column) -> Column:
    """Array of ``(kind, piece, ref, tokens)``, one per part and in order."""
    def one(p: Column, i: Column) -> Column:
        kind = F.coalesce(p["kind"], F.lit("other"))
        piece, tokens = F.lit("<|other|>"), F.lit(0).cast("long")
        for name, visitor in VISITORS.items():
            text, n = visitor(p)
            piece, tokens = F.when(kind == name, text).otherwise(piece), F.when(kind == name, n).otherwise(tokens)
        after_text = (i > 0) & (F.try_element_at(parts, i)["kind"] == "text")     # 1-based: the part before
        lead = F.when((kind == "text") & after_text, F.lit(SEP)).otherwise(F.lit(""))
        return F.struct(kind.alias("kind"), lead.alias("lead"), piece.alias("piece"), p["ref"].alias("ref"), tokens.alias("tokens"))

    return F.transform(parts, one)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation.

    ``formatted``; ``n_turns``; ``loss``: spans of the learned texts as ``(turn_no
    from 0, start in the conversation, start in the turn, length)`` in code points;
    ``attachments``: ``(turn_no, part_no, kind, ref, tokens, start)`` in order;
    ``expanded_tokens``: what all placeholders expand to."""
    part_type = turns.schema[parts].dataType
    cells = F.col(parts)
    if part_type.simpleString() != f"array<{PART}>":
        cells = cells.cast(f"array<{PART}>")
    empty = F.expr(f"cast(array() as array<{PART}>)")
    t = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.coalesce(F.col(role), F.lit("")).alias("_r"),
                     F.coalesce(cells, empty).alias("_p"))
    t = t.select("_c", "_t", "_r", visit(F.col("_p")).alias("_v"))
    t = t.select("_c", "_t", "_r", "_v", F.concat(F.lit(START), escape_role(F.col("_r")), F.lit("\n")).alias("_head"),
                 F.array_join(F.transform("_v", lambda v: F.concat(v["lead"], v["piece"])), "").alias("_body"))
    # where each part starts inside its turn
    ends = F.transform("_v", lambda v, i: F.aggregate(
        F.slice("_v", 1, i), F.char_length("_head").cast("long"),
        lambda a, x: a + F.char_length(x["lead"]) + F.char_length(x["piece"])) + F.char_length(v["lead"]))
    t = (t.withColumn("_at", ends)
         .withColumn("_turn", F.concat("_head", "_body", F.lit(END + "\n"))))
    order = Window.partitionBy("_c").orderBy(F.col("_t").asc_nulls_first(), "_r", "_body")
    t = (t.withColumn("_no", (F.row_number().over(order) - 1).cast("int"))
         .withColumn("_start", F.coalesce(F.sum(F.char_length("_turn").cast("long")).over(
             order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))))
    cell = F.arrays_zip("_v", "_at")
    learned = F.when(F.col("_r").isin(*learn), cell).otherwise(F.slice(cell, 1, 0))
    spans = F.transform(F.filter(learned, lambda z: z["_v"]["kind"] == "text"), lambda z: F.struct(
        F.col("_no").alias("turn_no"), (F.col("_start") + z["_at"]).alias("start"), z["_at"].alias("in_turn"),
        F.char_length(z["_v"]["piece"]).cast("long").alias("length")))
    held = F.filter(F.transform(cell, lambda z, i: F.struct(
        F.col("_no").alias("turn_no"), i.alias("part_no"), z["_v"]["kind"].alias("kind"), z["_v"]["ref"].alias("ref"),
        z["_v"]["tokens"].alias("tokens"), (F.col("_start") + z["_at"]).alias("start"))), lambda a: a["kind"] != "text")
    g = t.select("_c", F.struct("_no", "_turn", spans.alias("_loss"), held.alias("_held")).alias("_s"))
    g = g.groupBy("_c").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return g.select(
        F.col("_c").alias(conv), F.size("_s").cast("long").alias("n_turns"),
        F.array_join(F.transform("_s", lambda s: s["_turn"]), "").alias("formatted"),
        F.flatten(F.transform("_s", lambda s: s["_loss"])).alias("loss"),
        F.flatten(F.transform("_s", lambda s: s["_held"])).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted text says: ``turns`` as ``(role, text, parts)``, unescaped, and ``loss_text``,
    the text under the loss mask. ``parts`` are the typed parts ``(kind, text)`` in order: placeholders are told from
    texts before these are unescaped, each by itself; ``text`` is that of the text parts. The n-th
    placeholder of a turn is its n-th attachment. An empty text that is not next to a text leaves no trace."""
    whole = F.split("formatted", r"<\|im_end\|>\n")
    raw = formatted.withColumn("_raw", F.slice(whole, 1, F.size(whole) - 1))

    marks = r"<\|(?:image|audio|document|other)\|>"             # escaped texts hold none of them

    def typed(body: Column) -> Column:
        def part(piece: Column) -> Column:
            texts = F.transform(F.split(piece, SEP.replace("|", r"\|"), -1), lambda x: F.struct(F.lit("text").alias("kind"), unescape(x).alias("text")))
            mark = F.array(F.struct(F.regexp_extract(piece, r"^<\|(\w+)", 1).alias("kind"), F.lit(None).cast("string").alias("text")))
            return F.when(piece.rlike(f"^{marks}"), mark).otherwise(texts)

        pieces = F.filter(F.split(body, f"(?<={marks})|(?={marks})"), lambda x: x != "")
        return F.flatten(F.transform(pieces, part))

    def turn(s: Column) -> Column:
        return let(F.position(F.lit("\n"), s), lambda at: let(typed(F.substring(s, at + 1, F.char_length(s))), lambda parts: F.struct(
            unescape_role(F.substring(s, F.lit(len(START) + 1), at - F.lit(len(START) + 1))).alias("role"),
            F.array_join(F.transform(F.filter(parts, lambda p: p["kind"] == "text"), lambda p: p["text"]), "").alias("text"),
            parts.alias("parts"))))

    return (raw.withColumn("turns", F.transform("_raw", turn))
            .withColumn("loss_text", F.array_join(F.transform("loss", lambda x: unescape(F.substring(
                F.element_at(F.col("_raw"), x["turn_no"] + 1), (x["in_turn"] + 1).cast("int"), x["length"].cast("int")))), ""))
            .drop("_raw"))


def digest(read: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The contract's columns, from what was read back."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        conv, "n_turns", F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
