"""Secret scans: fixed patterns, and sliding-window entropy per character class; native expressions only.

The base patterns give spans of the kinds ``assign``, ``access`` and ``hex``. The method adds spans
of the kinds ``entropy_hex`` and ``entropy_base64``: a candidate is a run of the class's characters,
and a window of fixed width slides over it while counts per character and the sum of c*log2(c) are
updated by the character that leaves and the one that enters. A candidate whose largest window
entropy reaches the class's threshold is a span, unless the allow-list knows its form or a base
span overlaps it.

Spans are found by marking matches with a control character (any in the text is exchanged for
another first, which keeps positions) and adding up the lengths of the pieces, so positions are
code points. The time for a text with many matches grows little more than their number: pieces are
gathered in blocks, and overlaps with base spans are sought by halving.

Cases: a null text is empty; texts of any length are scanned whole; overlaps between base kinds are
kept; repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = (
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
)
#: Runs: a longer run holds no other match, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Per class: kind, the run's characters, window width, and least entropy in bits.
CLASSES = (
    ("entropy_hex", r"(?<![A-Za-z0-9+/_=-])[0-9A-Fa-f]{20,}(?![A-Za-z0-9+/_=-])", 20, 2.85),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.65),
)
#: The characters of the classes.
HEX_DIGITS = "0123456789ABCDEFabcdef"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Forms that are no secrets: UUIDs, dates and times, hyphen- or underscore-joined words, paths of words, placeholders.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^[0-9_+/=-]+$",
    r"^[A-Za-z_+/=-]+$",
    r"^[A-Za-z]+(?:[_/-]+[A-Za-z]+)*[_/-]?[0-9]{0,4}$",
    r"(?i)example|placeholder|changeme|dummy|x{6,}|0{8,}",
)
MARK, OTHER = "\u0001", "\u0003"
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _marked(pattern: str, replacement: str) -> str:
    return f"split(regexp_replace(t, {_sql(pattern)}, {_sql(replacement)}), {_sql(MARK)}, -1)"


def _let(name: str, value: str, rest: str) -> str:
    """SQL for ``rest``, in which ``name`` is ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {rest}), 1)"


def _folded(pieces: str, start: str, step: str, kind: str) -> str:
    """SQL for the array that a fold over ``pieces`` gathers; ``step`` sees the piece ``s`` and ``a`` with the place ``at`` and the number ``i``.

    Growing an array copies it. So the pieces are folded in blocks of about the root of their number
    (a multiple of 6, so that the number of a piece within its block tells what it is), each from the
    length of the blocks before it, and the blocks' arrays are joined at the end.
    """
    fold = f"flatten(zip_with(blocks, offsets, (block, o) -> aggregate(block, named_struct('at', o, 'i', 0, {start}'out', cast(array() AS {kind})), (a, s) -> {step}, a -> a.out)))"
    offsets = "aggregate(sums, named_struct('at', 0, 'out', cast(array() AS array<int>)), (a, n) -> named_struct('at', a.at + n, 'out', concat(a.out, array(a.at))), a -> a.out)"
    within = _let("sums", "transform(blocks, block -> aggregate(block, 0, (n, s) -> n + length(s)))", _let("offsets", offsets, fold))
    cut = "transform(sequence(0, cast((size(p) - 1) DIV width AS int)), b -> slice(p, b * width + 1, width))"
    return _let("p", pieces, _let("width", "cast(6 * ceil(sqrt(size(p)) / 6) AS int)", _let("blocks", cut, within)))


def _runs(pattern: str, rank: int) -> Column:
    """The spans of all matches of a pattern."""
    found = f"named_struct('start', a.at, 'rank', {rank}, 'end', a.at + length(s))"
    step = f"named_struct('at', a.at + length(s), 'i', a.i + 1, 'out', IF(a.i % 2 = 1, concat(a.out, array({found})), a.out))"
    return F.expr(f"CASE WHEN t RLIKE {_sql(pattern)} THEN {_folded(_marked(pattern, f'{MARK}$0{MARK}'), '', step, SPAN)} ELSE cast(array() AS {SPAN}) END")


def _assigned(rank: int = 0, least: int = 6) -> Column:
    """The spans of assignments whose value has ``least`` characters or more."""
    found = f"named_struct('start', a.from, 'rank', {rank}, 'end', a.at + length(s))"
    step = f"""named_struct('at', a.at + length(s), 'i', a.i + 1, 'from', IF(a.i % 3 = 1, a.at, a.from), 'out',
        IF(a.i % 3 = 2 AND length(s) >= {least}, concat(a.out, array({found})), a.out))"""
    return F.expr(f"CASE WHEN t RLIKE {_sql(ASSIGN)} THEN {_folded(_marked(ASSIGN, f'{MARK}$1{MARK}$2{MARK}'), "'from', 0, ", step, SPAN)} ELSE cast(array() AS {SPAN}) END")


def _window_entropy(text: str, width: int, alphabet: str) -> str:
    """SQL for the largest entropy, in bits, of ``width`` characters in a row of a string over an alphabet.

    Each step changes two of the counts: the sum of c*log2(c) moves by their differences.
    """
    gain = "IF({c} = 0, 0D, ({c} + 1) * log2({c} + 1D) - {c} * log2(cast({c} AS double)))"
    lose = "IF({c} = 1, 0D, ({c} - 1) * log2({c} - 1D) - {c} * log2(cast({c} AS double)))"
    come, gone = "codes[i]", f"codes[i - {width}]"
    rise = gain.format(c=f"a.n[{come}]")
    fall = lose.format(c=f"a.n[{gone}]")
    bits = f"log2({width}D) - a.s / {width}"
    return f"""
        element_at(transform(array(transform(split({text}, ''), x -> locate(x, {_sql(alphabet)}) - 1)), codes ->
          aggregate(sequence(0, size(codes) - 1),
            named_struct('n', array_repeat(0, {len(alphabet)}), 's', 0D, 'best', -1D),
            (a, i) -> named_struct(
              'n', transform(a.n, (v, j) -> v + IF(j = {come}, 1, 0) - IF(i >= {width} AND j = try_element_at(codes, greatest(i - {width} + 1, 1)), 1, 0)),
              's', CASE WHEN i < {width} THEN a.s + {rise} WHEN {come} = {gone} THEN a.s ELSE a.s + {rise} + {fall} END,
              'best', IF(i >= {width}, greatest(a.best, {bits}), a.best)),
            a -> greatest(a.best, {bits}))), 1)"""


def _apart(spans: str) -> str:
    """SQL for whether ``c`` overlaps none of ``spans``, which are in order and don't overlap: of those that begin before its end the last is sought by halving."""
    middle = "cast((a.low + a.high) DIV 2 AS int)"
    halve = f"IF(a.low >= a.high, a, IF({spans}[{middle}].start < c.end, named_struct('low', {middle} + 1, 'high', a.high), named_struct('low', a.low, 'high', {middle})))"
    before = f"aggregate(sequence(1, cast(ceil(log2(size({spans}) + 1D)) AS int) + 1), named_struct('low', 0, 'high', size({spans})), (a, i) -> {halve}, a -> IF(a.low = 0, true, {spans}[a.low - 1].end <= c.start))"
    return f"IF(size({spans}) = 0, true, {before})"


def _high_entropy(kind: str, pattern: str, width: int, least: float, alphabet: str, others: tuple[str, ...]) -> Column:
    """The spans of runs with a digit and a letter whose window entropy reaches the threshold, apart from those of ``others``."""
    rank = KINDS.index(kind)
    allowed = " OR ".join(f"c.s RLIKE {_sql(p)}" for p in ALLOWED)
    step = "named_struct('at', a.at + length(s), 'i', a.i + 1, 'out', IF(a.i % 2 = 1, concat(a.out, array(named_struct('start', a.at, 'end', a.at + length(s), 's', s))), a.out))"
    found = _folded(_marked(pattern, f"{MARK}$0{MARK}"), "", step, "array<struct<start:int,end:int,s:string>>")
    apart = " AND ".join(map(_apart, others))
    return F.expr(f"""
        CASE WHEN t RLIKE {_sql(pattern)} THEN transform(filter({found},
          c -> c.s RLIKE '[0-9]' AND c.s RLIKE '[A-Za-z]' AND {apart} AND NOT ({allowed}) AND {_window_entropy("c.s", width, alphabet)} >= {least}D),
          c -> named_struct('start', c.start, 'rank', {rank}, 'end', c.end)) ELSE cast(array() AS {SPAN}) END""")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for each row; one narrow pass, no shuffle."""
    rows = docs.select(F.col(key).alias("k"), F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), MARK, OTHER).alias("t"))
    rows = rows.select("k", "t", _assigned().alias("assign"), _runs(ACCESS, 1).alias("access"), _runs(HEX, 2).alias("hex"))
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    rows = rows.withColumn("e_hex", _high_entropy(*CLASSES[0], HEX_DIGITS, ("assign", "access", "hex")))
    rows = rows.withColumn("e_base64", _high_entropy(*CLASSES[1], BASE64, ("assign", "access", "hex", "e_hex")))

    def joined(spans: Column) -> Column:
        kinds = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.rank), s.start.cast("string"), s.end.cast("string"))), ",")

    return rows.select(
        F.col("k").alias(key),
        *[F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")],
        (F.size("e_hex") + F.size("e_base64")).cast("long").alias("n_entropy"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "e_hex", "e_base64"))).alias("spans"),
    )
