"""Personal data (4): patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds, leftmost and non-overlapping per kind: email, ip, card (16 to 19 digits, Luhn), phone.
The method adds iban (mod-97) and card_short (13 to 15 digits, Luhn), the latter only where a context
word lifts its score over the threshold. Base spans stay whatever their score.

The engine's regex functions give matches without places; the places follow from the text between
matches, added up in blocks of 256 so that texts with very many matches stay affordable. The
patterns below match what the base patterns do, written so that no run of characters is scanned
from each of its own characters again.

Null counts as empty. Repeated rows give repeated rows; extra columns are ignored (``redact`` keeps
them); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.functions.sqltext import lit


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: str  # SQL over v, the matched text
    score: float
    context: str  # words nearby that raise the score by 0.3
    screen: str  # SQL over the text: cheap, true wherever the pattern can match


def luhn(value: str) -> str:
    """SQL: do the digits of ``value`` pass the Luhn test?"""
    digits = f"reverse(regexp_replace({value}, '[^0-9]', ''))"
    digit = f"cast(substring({digits}, i, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, {digit}, {digit} * 2 - if({digit} > 4, 9, 0))) % 10 = 0"


def digit_count(value: str) -> str:
    return f"length(regexp_replace({value}, '[^0-9]', ''))"


def mod97(value: str) -> str:
    """SQL: is ``value`` 1 modulo 97, its first four characters last and letters read as 10 to 35?"""
    plain = f"replace({value}, ' ', '')"
    turned = f"concat(substring({plain}, 5), substring({plain}, 1, 4))"
    place = f"(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substring({turned}, i, 1)) - 1)"
    return f"aggregate(sequence(1, length({turned})), 0, (s, i) -> (s * if({place} > 9, 100, 10) + {place}) % 97) = 1"


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(low: int, high: int) -> str:
    """A whole run of digits with single separators that has ``low`` to ``high`` digits."""
    return rf"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){{{low - 1},{high - 1}}}+(?![ -]?[0-9])"


THRESHOLD = 0.5
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 0.7, r"\b(e-?mail|mail|contact|write)\b", "instr(t, '@') > 0"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", f"v rlike {lit(f'^{_PART}(?:[.]{_PART}){{3}}$')}", 0.6, r"\b(ip|host|server|address)\b", "instr(t, '.') > 0"),
    Kind("card", _digits(16, 19), luhn("v"), 0.7, r"\b(card|visa|credit|payment)\b", "true"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"{digit_count('v')} between 8 and 15", 0.6, r"\b(phone|tel|call|mobile|fax)\b", "instr(t, '+') > 0"),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", mod97("v"), 0.7, r"\b(iban|account|bank)\b", "true"),
    Kind("card_short", _digits(13, 15), luhn("v"), 0.3, r"\b(card|visa|amex|credit|payment)\b", "true"),
)
KINDS = BASE + ADDED

_SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"


def _parts(kind: Kind) -> tuple[str, str]:
    """SQL: the matches in t, and the texts around them (one more)."""
    pattern = lit(kind.pattern)
    return (
        f"if({kind.screen}, regexp_extract_all(t, {pattern}, 0), cast(array() as array<string>))",
        f"if(size(m) > 0, split(t, {pattern}, -1), array(t))",
    )


def _scored(kind: Kind) -> str:
    """SQL: score of match i, with 40 code points before it and 20 after it as context."""
    return f"({kind.score}D + if(concat(right(g[i], 40), ' ', left(g[i + 1], 20)) rlike {lit('(?i)' + kind.context)}, 0.3D, 0.0D))"


def _spans(kind: Kind) -> str:
    """SQL: the confirmed spans from matches m and surrounding texts g."""
    around = (
        "transform(m, (v, i) -> named_struct('v', v, 'lead', char_length(g[i]), 'long', char_length(v), "
        f"'ok', {kind.valid}, 'score', {_scored(kind)}))"
    )
    empty = "cast(array() as array<struct<v:string,start:int,end:int,ok:boolean,score:double>>)"
    at = "if(size(r) > 0, r[size(r) - 1].end, if(size(q) > 0, element_at(element_at(q, -1), -1).end, 0))"
    block = (
        f"aggregate(slice(w, k * 256 + 1, 256), {empty}, (r, x) -> concat(r, array(named_struct("
        f"'v', x.v, 'start', {at} + x.lead, 'end', {at} + x.lead + x.long, 'ok', x.ok, 'score', x.score))))"
    )
    blocks = f"aggregate(sequence(0, greatest(size(w) - 1, 0) div 256), cast(array() as array<array<struct<v:string,start:int,end:int,ok:boolean,score:double>>>), (q, k) -> concat(q, array({block})))"
    placed = f"transform(array({around}), w -> flatten({blocks}))[0]"
    keep = "x.ok" if kind in BASE else f"x.ok and x.score >= {THRESHOLD}D"
    made = f"transform(filter({placed}, x -> {keep}), x -> named_struct('kind', '{kind.name}', 'start', x.start, 'end', x.end, 'value', x.v, 'score', least(x.score, 1.0D)))"
    return f"if(size(m) > 0, {made}, cast(array() as {_SPAN}))"


def find_pii(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, and per kind an array of (kind, start, end, value, score) in order of start."""
    out = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    names = []
    for kind in KINDS:
        matches, around = _parts(kind)
        kept = ["doc_id", "t", *names]
        out = out.select(*kept, F.expr(matches).alias("m"))
        out = out.select(*kept, "m", F.expr(around).alias("g"))
        out = out.select(*kept, F.expr(_spans(kind)).alias(kind.name))
        names.append(kind.name)
    return out.drop("t")


_PIECE = 4096  # code points of a text that are looked at together when it is rebuilt


def _between(a: str, b: str) -> str:
    """SQL: the code points from a to b (exclusive) of a text cut into pieces ``k``, without walking over those before."""
    some = f"array_join(slice(k, {a} div {_PIECE} + 1, ({b} - 1) div {_PIECE} - {a} div {_PIECE} + 1), '')"
    return f"if({b} > {a}, substring({some}, {a} % {_PIECE} + 1, {b} - {a}), '')"


def _rebuilt() -> str:
    """SQL: the text of pieces ``k`` (``n`` code points) with the spans ``s``, in order of start, replaced; one for spans that overlap."""
    text = "cast(array() as array<string>)"
    step = (
        f"if(x.start >= a.reach, named_struct('reach', x.end, 'parts', concat(a.parts, array({_between('a.reach', 'x.start')}, x.shown))), "
        "named_struct('reach', greatest(a.reach, x.end), 'parts', a.parts))"
    )
    block = f"aggregate(slice(s, b * 256 + 1, 256), named_struct('reach', q.reach, 'parts', {text}), (a, x) -> {step})"
    added = f"get(transform(array({block}), w -> named_struct('reach', w.reach, 'out', concat(q.out, array(array_join(w.parts, ''))))), 0)"
    return f"aggregate(sequence(0, (size(s) - 1) div 256), named_struct('reach', 0, 'out', {text}), (q, b) -> {added}, q -> concat(array_join(q.out, ''), {_between('q.reach', 'n')}))"


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of ``find_pii`` replaced by the name of their kind in brackets; ``n_chars`` follows.

    All spans are found on the text as it is. Spans that overlap are replaced as one, under the name of the one that
    starts first (of ties the shorter), so nothing of the longer one is left. Null texts stay null.
    """
    out = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("x"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    names = []
    for kind in KINDS:
        matches, around = _parts(kind)
        kept = ["_row", "x", "t", *names]
        out = out.select(*kept, F.expr(matches).alias("m"))
        out = out.select(*kept, "m", F.expr(around).alias("g"))
        shown = f"transform({_spans(kind)}, x -> named_struct('start', x.start, 'end', x.end, 'shown', '[{kind.name.upper()}]'))"
        out = out.select(*kept, F.expr(shown).alias(kind.name))
        names.append(kind.name)
    out = out.select("_row", "x", "t", F.expr(f"array_sort(concat({', '.join(names)}))").alias("s"))
    pieces = f"if(size(s) > 0, regexp_extract_all(t, '(?s).{{1,{_PIECE}}}', 0), cast(array() as array<string>))"
    out = out.select("_row", "x", "s", F.expr(pieces).alias("k"), F.char_length("t").alias("n"))
    out = out.select("_row", F.expr(f"if(size(s) > 0, {_rebuilt()}, x)").alias("t"))
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.col("t").alias("text"))
        elif name == "n_chars":
            columns.append(F.when(F.col("t").eqNullSafe(F.col("_row.text")), F.col("_row.n_chars")).otherwise(F.char_length("t")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"_row.`{name}`").alias(name))
    return out.select(*columns)


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_pii``."""
    def listed(kinds: tuple[Kind, ...]) -> str:
        return f"array_join(transform(concat({', '.join(k.name for k in kinds)}), x -> concat_ws(':', x.kind, cast(x.start as string), cast(x.end as string))), ',')"

    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(listed(BASE)), 256).alias("base_sha256"), F.expr(listed(KINDS)).alias("spans"))
