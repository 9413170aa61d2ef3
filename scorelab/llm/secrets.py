"""Secret scans with SQL functions only: base patterns and sliding-window entropy per character class.

Base kinds are leftmost non-overlapping matches. The entropy kinds look at
candidate strings of one character class, unless the allow-list knows them. A
window of fixed width slides over a candidate. The state of the fold holds the
window's character counts (12 five-bit counts to a long) and S = sum of c * log2(c),
both updated by the character that enters and the one that leaves; the entropy is
log2(width) - S / width. Windows at or above the class's threshold are hot, and
what hot windows cover without a gap is one span, so cold text between two hot
places belongs to neither. Base spans are taken out of entropy spans; rests of
fewer than ``LEAST_PIECE`` characters beside them are no secrets of their own.

Work is linear in the text: a candidate of any length is folded in stretches of
``STRETCH`` windows that overlap by one window, texts are cut as UTF-32, where a
place is found without counting characters, and lists grow in short pieces.

Nulls count as empty text; positions are code points, ends exclusive. Matches
are found in whole texts; repeated rows are scanned each. ``redacted`` keeps all other columns, whatever
their names; ``scanned`` replaces columns that have one of its result names. An empty table stays empty.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order. ``least`` applies to the given group's length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
)

#: Entropy kinds: candidates, what a candidate must hold, window width, least entropy in bits.
ENTROPY = (
    ("entropy_hex", r"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{24,}+(?![A-Za-z0-9+/_=-])", r"^(?=.*[0-9])(?=.*[a-fA-F])", 24, 3.2),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 20, 3.7),
)

#: Candidates that are no secrets: identifiers with a public form, content hashes, dates, paths of words.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^sha(1|256|384|512)[-_=]",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T",
    r"^/?(?:[A-Za-z]++[0-9]{0,2}+[/_-])++[A-Za-z]*+[0-9]{0,2}+$",
)

#: Characters of all classes, those of hex first; inside base spans they are written as private characters.
ALPHABET = "0123456789abcdefABCDEFghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ+/_=-"
PRIVATE = "".join(chr(0xE000 + i) for i in range(len(ALPHABET)))
_ANY_PRIVATE = f"{PRIVATE[0]}-{PRIVATE[-1]}"
#: Windows that one fold slides over, and what a base span must leave of an entropy span.
STRETCH, LEAST_PIECE = 2048, 8
#: Items whose results are gathered before they join the others.
PIECE = 256

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"
_RANGE = "struct<from:int,to:int>"


def _quoted(pattern: str) -> str:
    """An SQL string literal; Spark reads backslash escapes and quotes inside one."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _empty(kind: str) -> str:
    return f"cast(array() as array<{kind}>)"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _gathered(items: str, carry: dict[str, str], step: dict[str, str], out: str, kind: str, last: str = "o.out") -> str:
    """Fold ``items`` (x) with state ``s``: ``carry`` gives its start, ``step`` its new values, ``out`` the items to append.

    Appending copies the list, so items are gathered a piece at a time and pieces are appended whole.
    """
    inner = ", ".join(f"'{n}', {v}" for n, v in step.items())
    names = ", ".join(f"'{n}', o.{n}" for n in carry)
    start = ", ".join(f"'{n}', {v}" for n, v in carry.items())
    fold = f"aggregate(slice(l, j * {PIECE} + 1, {PIECE}), named_struct({names}, 'out', {_empty(kind)}), (s, x) -> named_struct({inner}, 'out', {out}))"
    kept = ", ".join(f"'{n}', r.{n}" for n in carry)
    whole = f"aggregate(sequence(0, cast((size(l) - 1) div {PIECE} as int)), named_struct({start}, 'out', {_empty(kind)}), (o, j) -> {_let(fold, 'r', f'named_struct({kept}, {chr(39)}out{chr(39)}, concat(o.out, r.out))')}, o -> {last})"
    return _let(items, "l", f"if(size(l) = 0, {_empty(kind)}, {whole})")


def _placed(hits: str, gaps: str, rank: int, kind: str) -> str:
    """Spans of all matches from the matched strings and what lies between them."""
    items = f"transform({hits}, (h, i) -> named_struct('gap', length({gaps}[i]), 'hit', length(h)))"
    span = f"named_struct('start', s.at + x.gap, 'rank', {rank}, 'end', s.at + x.gap + x.hit, 'kind', '{kind}')"
    return _gathered(items, {"at": "0"}, {"at": "s.at + x.gap + x.hit"}, f"concat(s.out, array({span}))", _SPAN)


def _united(spans: str) -> str:
    """Ranges (from, to) that sorted spans cover, touching ones joined."""
    closed = "if(x.start > s.to and s.to >= 0, concat(s.out, array(named_struct('from', s.from, 'to', s.to))), s.out)"
    step = {"from": "if(x.start > s.to, x.start, s.from)", "to": "greatest(s.to, x.end)"}
    last = "concat(o.out, array(named_struct('from', o.from, 'to', o.to)))"
    return _gathered(spans, {"from": "-1", "to": "-1"}, step, closed, _RANGE, last)


def _cut(wide: str, start: str, end: str) -> str:
    """Characters from ``start`` up to ``end`` of a text in UTF-32, without counting the ones before."""
    return f"decode(substring({wide}, 4 * ({start}) + 1, 4 * (({end}) - ({start}))), 'UTF-32')"


def _outside(ranges: str, size: str) -> str:
    """The (from, to) before, between and after sorted disjoint ranges."""
    start = f"if(i = 0, 0, {ranges}[i - 1].to)"
    end = f"if(i = size({ranges}), {size}, {ranges}[i].from)"
    return f"transform(sequence(0, size({ranges})), i -> named_struct('from', {start}, 'to', {end}))"


def _matches(df: DataFrame, text: str, name: str, rank: int, kind: str, pattern: str) -> DataFrame:
    """Add ``<name>`` (spans) and ``<name>_hits`` (matched strings)."""
    p = _quoted(pattern)
    df = df.withColumn(f"{name}_hits", F.expr(f"regexp_extract_all({text}, {p}, 0)"))
    df = df.withColumn(f"{name}_gaps", F.expr(f"if(size({name}_hits) = 0, array(''), split({text}, {p}, -1))"))
    return df.withColumn(name, F.expr(_placed(f"{name}_hits", f"{name}_gaps", rank, kind))).drop(f"{name}_gaps")


def _with_private(pattern: str) -> str:
    """A candidate pattern that goes through characters of base spans."""
    hexes = f"{PRIVATE[0]}-{PRIVATE[21]}"
    return pattern.replace("[0-9a-fA-F]", f"[0-9a-fA-F{hexes}]").replace("A-Za-z0-9+/_=-]", f"A-Za-z0-9+/_={_ANY_PRIVATE}-]")


def _marked(text: str, covered: str) -> str:
    """The text with the class characters of base spans made private, and private ones of its own blanked."""
    inside = f"transform({covered}, x -> translate({_cut('w', 'x.from', 'x.to')}, '{ALPHABET}', '{PRIVATE}'))"
    blank = f"regexp_replace({_cut('w', 'x.from', 'x.to')}, '[{_ANY_PRIVATE}]', ' ')"
    outside = f"transform({_outside(covered, f'length({text})')}, x -> {blank})"
    joined = f"array_join(flatten(zip_with({outside}, {inside}, (a, b) -> array(a, coalesce(b, '')))), '')"
    plain = f"if({text} rlike '[{_ANY_PRIVATE}]', regexp_replace({text}, '[{_ANY_PRIVATE}]', ' '), {text})"
    return f"if(size({covered}) = 0, {plain}, {_let(f'encode({text}, {chr(39)}UTF-32{chr(39)})', 'w', joined)})"


def _hot_ranges(text: str, width: int, bits: float) -> str:
    """(from, to) of what hot windows of a short text cover, less its private characters.

    The table's terms go into S and out of it alike, so 1e-9 covers rounding.
    """
    most = width * (math.log2(width) - bits) + 1e-9
    term = [c * math.log2(c) if c else 0.0 for c in range(width + 2)]
    gain = "array(" + ", ".join(f"{b - a!r}D" for a, b in zip(term, term[1:])) + ")"
    counts = -(-len(ALPHABET) // 12)
    code = f"pmod(instr('{ALPHABET}{PRIVATE}', ch) - 1, {len(ALPHABET)})"
    codes = f"transform(slice(split({text}, ''), 1, length({text})), ch -> {code})"
    # each character with the one that leaves as it enters: word and bit offset of both counts
    moves = f"transform(k, (a, i) -> {_let(f'if(i >= {width}, k[i - {width}], -1)', 'z', _MOVE)})"
    n_in = "cast(shiftright(s.counts[x.aw], x.ab) & 31 as int)"
    n_out = "cast(shiftright(s.counts[x.zw], x.zb) & 31 as int) + if(x.same, 1, 0) - 1"
    total = f"s.sum + {gain}[{n_in}] - if(x.zw < 0, 0D, {gain}[{n_out}])"
    changed = "transform(s.counts, (v, n) -> v + if(n = x.aw, shiftleft(1L, x.ab), 0L) - if(n = x.zw, shiftleft(1L, x.zb), 0L))"
    # a step first judges the window that the step before has completed
    hot = f"(s.at >= {width} and s.sum <= {most!r}D)"
    apart = f"({hot} and s.at - {width} > s.to)"
    closed = f"if({apart} and s.to >= 0, concat(s.out, array(named_struct('from', s.from, 'to', s.to))), s.out)"
    step = {
        "at": "s.at + 1", "sum": total, "counts": changed,
        "from": f"if({apart}, s.at - {width}, s.from)", "to": f"if({hot}, s.at, s.to)", "out": closed,
    }
    start = f"named_struct('at', 0, 'sum', 0D, 'counts', array_repeat(0L, {counts}), 'from', -1, 'to', -1, 'out', {_empty(_RANGE)})"
    fold = f"aggregate(concat({moves}, array(named_struct('aw', 0, 'ab', 0, 'zw', -1, 'zb', 0, 'same', false))), {start}, (s, x) -> named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {v}' for n, v in step.items())}), s -> if(s.to < 0, s.out, concat(s.out, array(named_struct('from', s.from, 'to', s.to)))))"
    ranges = _let(codes, "k", fold)
    return f"if(length({text}) < {width}, {_empty(_RANGE)}, {ranges})"


_MOVE = (
    "named_struct('aw', cast(a div 12 as int), 'ab', 5 * (a % 12), 'zw', if(z < 0, -1, cast(z div 12 as int)), 'zb', if(z < 0, 0, 5 * (z % 12)), 'same', a = z)"
)


def _less_private(text: str, ranges: str) -> str:
    """The ranges without the private characters of ``text``."""
    hits = f"regexp_extract_all(t, '[^{_ANY_PRIVATE}]+', 0)"
    gaps = f"split(t, '[^{_ANY_PRIVATE}]+', -1)"
    free = _placed("f", "g", 0, "")
    both = (
        f"flatten(transform({ranges}, r -> transform(filter(p, x -> x.start < r.to and r.from < x.end), "
        "x -> named_struct('from', greatest(r.from, x.start), 'to', least(r.to, x.end)))))"
    )
    found = _let(hits, "f", _let(gaps, "g", _let(free, "p", both)))
    return _let(text, "t", f"if(t rlike '[{_ANY_PRIVATE}]', {found}, {ranges})")


def _entropy_ranges(candidate: str, width: int, bits: float) -> str:
    """(from, to) of a candidate's secrets: stretch by stretch, then ranges that overlap become one."""
    piece = _cut("w", f"j * {STRETCH}", f"least(length(c), (j + 1) * {STRETCH} + {width - 1})")
    own = _let(piece, "q", _let(_hot_ranges("q", width, bits), "h", _less_private("q", "h")))
    shifted = f"transform({own}, r -> named_struct('from', r.from + j * {STRETCH}, 'to', r.to + j * {STRETCH}))"
    every = f"array_sort(flatten(transform(sequence(0, cast((length(c) - 1) div {STRETCH} as int)), j -> {shifted})))"
    # sorted starts have sorted ends here, so neighbours tell where a union begins and ends
    starts = "filter(transform(e, (r, i) -> if(i = 0 or r.from > e[i - 1].to, r.from, -1)), v -> v >= 0)"
    ends = "filter(transform(e, (r, i) -> if(i = size(e) - 1 or e[i + 1].from > r.to, r.to, -1)), v -> v >= 0)"
    joined = f"filter(zip_with({starts}, {ends}, (a, b) -> named_struct('from', a, 'to', b)), r -> r.to - r.from >= {LEAST_PIECE})"
    united = _let(_let("encode(c, 'UTF-32')", "w", every), "e", f"if(size(e) = 0, {_empty(_RANGE)}, {joined})")
    return _let(candidate, "c", united)


def scanned(docs: DataFrame) -> DataFrame:
    """Add ``base_spans`` and ``all_spans``: arrays of (start, rank, end, kind), sorted by start, then kind."""
    df = docs.withColumn("_secret_text", F.coalesce(F.col("text"), F.lit("")))
    names = []
    for rank, (kind, pattern, least) in enumerate(BASE):
        name = f"_s_{kind}"
        df = _matches(df, "_secret_text", name, rank, kind, pattern)
        if least:
            value = f"length(regexp_extract({name}_hits[i], {_quoted(pattern)}, 1))"
            df = df.withColumn(name, F.expr(f"filter({name}, (x, i) -> {value} >= {least})"))
        names.append(name)
    df = df.withColumn("base_spans", F.array_sort(F.concat(*names)))
    df = df.withColumn("_s_covered", F.expr(_united("base_spans")))
    df = df.withColumn("_s_marked", F.expr(_marked("_secret_text", "_s_covered")))
    added = []
    plain = f"translate(h, '{PRIVATE}', '{ALPHABET}')"
    allowed = " or ".join(f"c rlike {_quoted(p)}" for p in ALLOWED)
    for rank, (kind, pattern, needs, width, bits) in enumerate(ENTROPY, len(BASE)):
        name = f"_s_{kind}"
        df = _matches(df, "_s_marked", name, rank, kind, _with_private(pattern))
        wanted = _let(plain, "c", f"c rlike {_quoted(needs)} and not ({allowed})")
        found = f"transform({name}_hits, h -> if({wanted}, {_entropy_ranges('h', width, bits)}, {_empty(_RANGE)}))"
        df = df.withColumn(f"{name}_found", F.expr(found))
        moved = (
            f"flatten(transform({name}, (x, i) -> transform({name}_found[i], r -> "
            "named_struct('start', x.start + r.from, 'rank', x.rank, 'end', x.start + r.to, 'kind', x.kind))))"
        )
        df = df.withColumn(name, F.expr(moved))
        added.append(name)
    df = df.withColumn("all_spans", F.array_sort(F.concat("base_spans", *added)))
    return df.drop(*[c for c in df.columns if c.startswith("_s_")])


def joined(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span replaced by ``mark``; overlapping and touching spans become one."""
    held = docs.select(F.struct("*").alias("row"), "text")
    found = scanned(held).withColumn("_merged", F.expr(_united("all_spans")))
    pieces = f"transform({_outside('_merged', 'length(text)')}, x -> {_cut('w', 'x.from', 'x.to')})"
    cut = _let("encode(text, 'UTF-32')", "w", f"array_join({pieces}, {_quoted(mark)})")
    out = found.withColumn("text", F.expr(f"if(size(_merged) = 0, text, {cut})"))
    changed = F.when(F.size("_merged") > 0, F.length("text").cast("long"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(changed, columns["n_chars"])
    return out.select(*[v.alias(c) for c, v in columns.items()])
