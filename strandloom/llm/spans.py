"""Regular-expression spans with code-point offsets, as DataFrame expressions only.

The cost of every expression here stays near the text's length however many spans a text has: offsets are running
totals, words around a span come from the pieces next to it, and texts are cut piece by piece.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.arrays import largest, let, running

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,hit:string,before:string>>"
#: Code points before a span in which a context word counts.
CONTEXT_CHARS = 40
#: A raw match has at least four code points, so as many matches and the pieces before them hold CONTEXT_CHARS.
_CONTEXT_PIECES = CONTEXT_CHARS // 4


def no_spans() -> Column:
    return F.array().cast(SPAN_TYPE)


def find(kind: str, text: Column, pattern: str, need: str | None = None) -> Column:
    """The pattern's leftmost non-overlapping matches in order: kind, start, end, hit and the text ``before`` it.

    ``need`` is a shorter pattern that any match contains; a text without it is not searched.  The patterns are
    written so that Java's matcher needs neither recursion nor quadratic time on long texts.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if need is not None:
        has = text.contains(need) if len(need) == 1 else text.rlike(need)
        found = F.when(has, found).otherwise(F.array().cast("array<string>"))

    def between(h: Column) -> Column:
        return F.when(F.size(h) > 0, let(F.split(text, pattern, -1), lambda g: _placed(kind, h, g))).otherwise(no_spans())

    return let(found, between)


def _placed(kind: str, h: Column, g: Column) -> Column:
    """Spans of the matches ``h`` from them and the pieces ``g`` between them."""
    lengths = F.transform(h, lambda hit, i: F.length(F.get(g, i)) + F.length(hit))
    tails = F.transform(h, lambda hit, i: F.right(F.concat(F.get(g, i), hit), F.lit(CONTEXT_CHARS)))

    def spans(x: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            piece = F.get(g, i)
            first = F.greatest(i - _CONTEXT_PIECES + 1, F.lit(1))
            nearby = F.array_join(F.slice(x["tails"], first, i - first + 1), "")
            start = F.get(x["begins"], i) + F.length(piece)
            return F.struct(
                F.lit(kind).alias("kind"),
                start.alias("start"),
                (start + F.length(hit)).alias("end"),
                hit.alias("hit"),
                F.right(F.when((i == 0) | (F.length(piece) >= CONTEXT_CHARS), piece).otherwise(F.concat(nearby, piece)), F.lit(CONTEXT_CHARS)).alias("before"),
            )

        return F.transform(h, one)

    return let(F.struct(running(lengths).alias("begins"), tails.alias("tails")), spans)


def replaced(text: Column, spans: Column, label) -> Column:
    """The text with each of the spans (start, end, ...), in order of their starts, replaced by ``label`` of it.

    A span that begins inside those before it has no label of its own; the text it covers goes too.  Pieces are cut
    from blocks of about the square root of the spans' number, so that few cuts start at the text's beginning.
    """

    def whole(x: Column) -> Column:
        size = F.size(x["spans"])
        step = F.ceil(F.sqrt(size.cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), size - 1, step), lambda b: block(x, b, F.least(b + step, size)))
        last = F.greatest(F.element_at(x["reach"], -1), F.element_at(x["spans"], -1)["end"])
        return F.concat(F.array_join(blocks, ""), F.substring(x["text"], last + 1, F.length(x["text"])))

    def block(x: Column, b: Column, stop: Column) -> Column:
        begin = F.get(x["reach"], b)
        end = F.greatest(begin, F.get(x["spans"], stop - 1)["start"])

        def pieces(part: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                at = F.get(x["reach"], b + i)
                shown = F.concat(F.substring(part, at - begin + 1, s["start"] - at), label(s))
                return F.when(s["start"] < at, F.lit("")).otherwise(shown)

            return F.array_join(F.transform(F.slice(x["spans"], b + 1, stop - b), piece), "")

        return let(F.substring(x["text"], begin + 1, end - begin), pieces)

    reach = lambda y: F.struct(y["text"].alias("text"), y["spans"].alias("spans"), running(F.transform(y["spans"], lambda s: s["end"]), largest).alias("reach"))
    bound = F.struct(F.coalesce(text, F.lit("")).alias("text"), spans.alias("spans"))
    return F.when(F.size(spans) > 0, let(let(bound, reach), whole)).otherwise(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined ("" for none)."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
