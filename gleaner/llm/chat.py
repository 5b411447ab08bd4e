"""Chat formatting of typed content parts, in DataFrame functions only.

A turn becomes <|turn|>ROLE<|says|>CONTENT<|end|>. CONTENT is what a visitor
makes of the turn's parts, in order: text parts that follow each other are joined
and then escaped, so that no control string can be put together from several, and
each image, audio or document part is a placeholder, whose reference and expanded
token count are recorded as an attachment. The k-th placeholder of the output is
the k-th attachment.

Control strings inside roles and texts get a word joiner (U+2060) behind their
first character, and a word joiner of the text itself is doubled; unescape()
undoes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
JOINER = "⁠"
CONTROL = r"([<\[])(\|[^|<>\[\]]{1,32}\|>|/?s>|/?INST\])"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of a placeholder: by 14-pixel patches, per second and per page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 512


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(JOINER), F.lit(JOINER * 2)), F.lit(CONTROL), F.lit(f"$1{JOINER}$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(f"{JOINER}({JOINER}?)"), F.lit("$1"))


def _none(x: Column, default) -> Column:
    return F.coalesce(x, F.lit(default))


def _visit_content(parts: Column) -> Column:
    """The parts as one string; `run` is the text since the last placeholder, not escaped yet."""

    def visit(a: Column, p: Column) -> Column:
        sign = F.concat(F.lit("<|"), F.when(p["kind"].isin("image", "audio"), p["kind"]).otherwise(F.lit("document")), F.lit("|>"))
        is_text = _none(p["kind"], "text") == "text"
        done = F.when(is_text, a["done"]).otherwise(F.concat(a["done"], escape(a["run"]), sign))
        run = F.when(is_text, F.concat(a["run"], _none(p["text"], ""))).otherwise(F.lit(""))
        return F.struct(done.alias("done"), run.alias("run"))

    return F.aggregate(parts, F.struct(F.lit("").alias("done"), F.lit("").alias("run")), visit, lambda a: F.concat(a["done"], escape(a["run"])))


def _visit_tokens(p: Column) -> Column:
    image = F.ceil(_none(p["width"], PATCH) / PATCH) * F.ceil(_none(p["height"], PATCH) / PATCH)
    return F.when(p["kind"] == "image", image).when(p["kind"] == "audio", F.ceil(_none(p["seconds"], 0.0) * PER_SECOND)).otherwise(_none(p["pages"], 1) * PER_PAGE).cast("long")


def text_part(text: Column) -> Column:
    """A content array of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation, from rows (conv_id, turn, role, parts array<PART>).

    segments: the output in pieces with `train`, true on an assistant's content;
    formatted: the pieces joined; attachments: (kind, ref, n_tokens) in the order of
    the placeholders; expanded_tokens: their sum. Turns are ordered by (turn, role,
    content), null turns first; null roles, texts and parts are empty; a part of
    unknown kind is a document; repeated rows repeat their turn; null conv_ids
    form one conversation; extra columns are ignored.
    """
    parts = _none(F.col("parts"), F.array().cast(f"array<{PART}>"))
    one = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            _none(F.col("role"), "").alias("role"),
            _visit_content(parts).alias("content"),
            F.transform(F.filter(parts, lambda p: _none(p["kind"], "text") != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), _visit_tokens(p).alias("n_tokens"))).alias("files"),
        ).alias("t"),
    )
    chats = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    pieces = F.flatten(
        F.transform(
            "ts",
            lambda t: F.array(
                F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS)).alias("text"), F.lit(False).alias("train")),
                F.struct(t["content"].alias("text"), (t["role"] == "assistant").alias("train")),
                F.struct(F.lit(END).alias("text"), F.lit(False).alias("train")),
            ),
        )
    )
    out = chats.select("conv_id", pieces.alias("segments"), F.flatten(F.transform("ts", lambda t: t["files"])).alias("attachments"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("expanded_tokens"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; placeholders stay as they are."""
    bare = F.slice(F.split(formatted, r"<\|end\|>"), 1, F.greatest(F.size(F.split(formatted, r"<\|end\|>")) - 1, F.lit(0)))
    halves = F.transform(bare, lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), r"<\|says\|>"))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def op9(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    chats = format_chats(rows.unionByName(probe).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["train"]), lambda s: unescape(s["text"])), "")
    read = chats.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_ESC = r"length(regexp_replace(replace({}, chr(8288), chr(8288) || chr(8288)), '([<\[])(\|[^|<>\[\]]{{1,32}}\|>|/?s>|/?INST\])', '\1' || chr(8288) || '\2', 'g'))"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum({len(TURN) + len(SAYS) + len(END)} + {_ESC.format("role")} + {_ESC.format("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
