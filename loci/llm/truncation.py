"""Texts cut off by a length limit of their source, or in transfer.

A source with a limit leaves a spike at the maximum of its length histogram, in characters or in
bytes; a value at such a length is cut unless it ends a sentence. The spike decides for the endings
that say little by themselves: a closing line (signature, sign-off, tags, fence, link) or the bare
number of a list item ends many complete texts, but not one that has just the length of the limit.
Away from a spike, where only a transfer can have cut it, a text is cut if it bears a mark or stops
inside a word or a sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A cut at a byte limit may lose up to three bytes of a broken character, and a cut text its last blanks.
SPIKE_WIDTH = 4
#: Distinct texts a spike needs, and how many times denser than the upper half of the histogram it must be.
SPIKE_TEXTS = 5
SPIKE_DENSITY = 5.0

_TERMINAL = r"""(^|[^.])[.!?。！？]["'”’»)\]}*_`]*$"""
_CUT_MARK = r"""(\.\.\.|…|\x{FFFD}|\[\.\.\.\]|\[…\]|[\[(<](truncated|cut|snip|more)[\])>])["'”’)\]]*$"""
_NUMBER_ONLY = r"^\s*[-*>]?\s*(\d{1,3}|[a-zA-Z])[.)]$"
_CLOSED_REMARK = r"""[.!?:"”]\s*[(\[][^()\[\]\n]{1,60}[)\]]$"""
_CLOSING_LINE = (
    r"^(--?\s*\p{L}[\p{L} .'-]{0,40}"  # signature
    r"|(#[\p{L}\d_-]+\s*)+"  # tags
    r"|EOF|END|###"
    r"|[-*] \[[ xX]\] \p{L}+"  # ticked item
    r"|[\[(<][^\[\]()<>\n]{1,60}[\])>]"  # remark on its own line
    r"|<?https?://\S+>?)$"
)
_SIGN_OFF = r"(?i)^(best|best regards|regards|kind regards|thanks|thank you|cheers|sincerely|yours|viele grüße|mit freundlichen grüßen|grüße|saludos|un saludo|gracias),?$"


def ending(text: Column) -> Column:
    """How a text ends: 'blank', 'marked', 'terminal', 'closing', 'number' or 'open'.

    'marked' bears a cut mark (ellipsis, replacement character, "[truncated]"); 'closing' ends in a
    line that finishes a text without punctuation, 'number' in the bare number of a list item with
    its full stop or bracket; 'open' stops inside a word or a sentence. Null
    and white-space texts are 'blank'. Only the last 400 characters are matched against patterns;
    code fences are counted over the whole text.
    """
    tail = F.regexp_replace(F.right(text, F.lit(400)), r"\s+$", "")
    lines = F.split(tail, r"\n")
    last = F.trim(F.element_at(lines, -1))
    before = F.trim(F.coalesce(F.try_element_at(lines, F.lit(-2)), F.lit("")))
    fences = F.floor((F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("")))) / 3)
    fenced = last.startswith("```") & (fences % 2 == 0) & (last == F.lit("```"))
    signed = before.rlike(_SIGN_OFF) & last.rlike(r"^\p{Lu}[\p{L}'-]*( \p{Lu}[\p{L}'.-]*){0,2}$")
    return (
        F.when(text.isNull() | (F.length(tail) == 0), "blank")
        .when(tail.rlike(_CUT_MARK), "marked")
        .when(last.rlike(_NUMBER_ONLY), "number")
        .when(tail.rlike(_TERMINAL) | tail.rlike(_CLOSED_REMARK), "terminal")
        .when(fenced | signed | last.rlike(_CLOSING_LINE), "closing")
        .otherwise("open")
    )


def length_limits(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``(source, unit, limit, texts_at_limit)``: the sources whose length histogram has a spike at its maximum.

    Histograms are per source and unit ('chars', 'bytes'), over distinct texts, so copies of one
    text make no spike. Spike: at least ``SPIKE_TEXTS`` texts within ``SPIKE_WIDTH`` of the maximum
    and ``SPIKE_DENSITY`` times as many as the upper half of the range would put there. A null
    source is a source of its own; null and blank texts take no part.
    """
    src = docs.select(F.col(source).alias("source"), F.col(text).alias("text")).where(F.length(F.trim("text")) > 0)
    seen = (
        src.select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("h"))
        .groupBy("source", "chars", "bytes", "h")
        .agg(F.lit(1).alias("one"))
        .groupBy("source", "chars", "bytes")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    unit = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    hist = seen.select("source", "n", unit.alias("u")).groupBy("source", "u.unit", "u.length").agg(F.sum("n").alias("n"))
    # A window over a histogram: its size is the number of different lengths, not of rows.
    top = F.max("length").over(Window.partitionBy("source", "unit"))
    at = F.col("length") > F.col("limit") - SPIKE_WIDTH
    upper = (F.col("length") > F.col("limit") / 2) & ~at
    return (
        hist.withColumn("limit", top)
        .groupBy("source", "unit", "limit")
        .agg(F.sum(F.when(at, F.col("n")).otherwise(0)).alias("texts_at_limit"), F.sum(F.when(upper, F.col("n")).otherwise(0)).alias("upper"))
        .where(
            (F.col("texts_at_limit") >= SPIKE_TEXTS)
            & (F.col("texts_at_limit") >= SPIKE_DENSITY * SPIKE_WIDTH * F.col("upper") / F.greatest(F.col("limit") / 2 - SPIKE_WIDTH, F.lit(1)))
        )
        .select("source", "unit", "limit", "texts_at_limit")
    )


def assessed(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(ident, source, ending, at_limit, truncated)`` for every row of ``docs``.

    Blank texts are never truncated. Rows are kept as they are: repeats of an id give repeated
    rows. Other columns are ignored, so clashing names do no harm. An empty table gives no rows.
    """
    limits = length_limits(docs, text, source)
    limits = limits.groupBy("source").agg(
        F.max(F.when(F.col("unit") == "chars", F.col("limit"))).alias("max_chars"),
        F.max(F.when(F.col("unit") == "bytes", F.col("limit"))).alias("max_bytes"),
    )
    rows = docs.select(
        F.col(ident).alias("id"),
        F.col(source).alias("source"),
        F.length(text).alias("chars"),
        F.octet_length(text).alias("bytes"),
        ending(F.col(text)).alias("ending"),
    )
    at = (F.col("chars") > F.col("max_chars") - SPIKE_WIDTH) | (F.col("bytes") > F.col("max_bytes") - SPIKE_WIDTH)
    joined = rows.alias("r").join(limits.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source")), "left")
    at = F.coalesce(at, F.lit(False))
    cut = F.col("ending").isin("open", "marked") | (at & F.col("ending").isin("closing", "number"))
    return joined.select(
        F.col("r.id").alias(ident), F.col("r.source").alias(source), "ending", at.alias("at_limit"), cut.alias("truncated")
    )


def truncation_shares(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(source, texts, truncated, at_limit, share)`` per source, over all rows with a text that is not blank."""
    per = assessed(docs, ident, text, source).where(F.col("ending") != "blank")
    return per.groupBy(source).agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
        F.sum((F.col("truncated") & F.col("at_limit")).cast("long")).alias("at_limit"),
        F.avg(F.col("truncated").cast("double")).alias("share"),
    )
