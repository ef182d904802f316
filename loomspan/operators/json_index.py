"""Vectorised structural index of JSON texts.

A whole Arrow batch of texts is indexed at once with numpy: bitmaps of quotes, brackets and delimiters,
string parity and nesting depth as prefix sums, then one token per bracket, delimiter, string and bare
scalar with its span, container, key and place. Nothing is parsed row by row.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUOTE, OBJ, OBJ_END, ARR, ARR_END, COLON, COMMA, LINE, SCALAR, STRING = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10

_CLASS = np.zeros(256, np.uint8)
for _b, _c in zip(b'"{}[]:,\n', (QUOTE, OBJ, OBJ_END, ARR, ARR_END, COLON, COMMA, LINE)):
    _CLASS[_b] = _c
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True


def _scalar_automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition table, accepting states and the kind of scalar each accepting state stands for."""
    table = np.zeros((32, 256), np.uint8)  # state 0 is the sink, 1 the start
    accept, kind = np.zeros(32, bool), np.zeros(32, "U8")
    digits = list(b"0123456789")
    minus, zero, whole, dot, frac, exp, sign, power = range(2, 10)
    table[1, ord("-")] = minus
    for state in (1, minus):
        table[state, digits[1:]] = whole
        table[state, ord("0")] = zero
    table[whole, digits] = whole
    for state in (zero, whole):
        table[state, ord(".")] = dot
        accept[state], kind[state] = True, "integer"
    table[dot, digits] = frac
    table[frac, digits] = frac
    for state in (zero, whole, frac):
        table[state, [ord("e"), ord("E")]] = exp
    table[exp, [ord("+"), ord("-")]] = sign
    for state in (exp, sign, power):
        table[state, digits] = power
    for state in (frac, power):
        accept[state], kind[state] = True, "number"
    free = 10
    for word, name in ((b"true", "boolean"), (b"false", "boolean"), (b"null", "null")):
        state = 1
        for c in word:
            table[state, c] = free
            state, free = free, free + 1
        accept[state], kind[state] = True, name
    return table, accept, kind


_STEP, _ACCEPT, _KIND = _scalar_automaton()


@dataclass
class Tokens:
    """Tokens of a batch in order of place. Spans are byte ranges [start, end) of data; -1 is none.

    kind: one of the constants; doc: row of the batch; container: token that opens the object or list
    around it; item: place among the container's members; key: token of the member's name; match: a
    bracket's other bracket; ok: allowed where it stands; scalar: state of the scalar automaton;
    is_key, is_value: what the token is in its container.
    """

    data: np.ndarray
    kind: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    container: np.ndarray
    item: np.ndarray
    key: np.ndarray
    match: np.ndarray
    ok: np.ndarray
    scalar: np.ndarray
    is_key: np.ndarray
    is_value: np.ndarray
    valid: np.ndarray  # for each row: one complete JSON text


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string column; a null has no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    n, buffers = len(column), column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as a string column, copied in one go."""
    size = np.maximum(end - start, 0)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    body = data[at] if len(at) else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))).cast(pa.string())


def decoded(raw: str) -> str:
    """A JSON string's content with its escapes resolved; as written where it has half of a surrogate pair, which no text can hold."""
    try:
        text = json.loads(f'"{raw}"')
        text.encode()
    except (ValueError, UnicodeEncodeError):
        return raw
    return text


def escaped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans hold a backslash."""
    slash = np.flatnonzero(data == 92)
    if not len(slash):
        return np.zeros(len(start), bool)
    return np.searchsorted(slash, start) < np.searchsorted(slash, end)


def names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans, contents of strings, as texts; those with escapes are decoded one by one."""
    out = gather(data, start, end)
    odd = np.flatnonzero(escaped(data, start, end))
    if not len(odd):
        return out
    texts = out.to_pylist()
    for i in odd:
        texts[i] = decoded(texts[i])
    return pa.array(texts, pa.string())


#: A name that stands in a path as it is.
PLAIN = "^[A-Za-z0-9_]+$"


def quoted(found: pa.Array) -> pa.Array:
    """Names as they stand in paths."""
    return pc.if_else(pc.match_substring_regex(found, PLAIN), found, pc.binary_join_element_wise('"', found, '"', ""))


def span_equals(data: np.ndarray, start: np.ndarray, end: np.ndarray, word: str) -> np.ndarray:
    """Whether the spans, contents of strings, are the word, also where they are written with escapes."""
    raw = word.encode()
    same = (end - start) == len(raw)
    for i, c in enumerate(raw):
        at = np.flatnonzero(same)
        same[at] = data[start[at] + i] == c
    odd = np.flatnonzero(escaped(data, start, end))
    if len(odd):
        same[odd] = [decoded(x) == word for x in gather(data, start[odd], end[odd]).to_pylist()]
    return same


def span_integer(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The spans as whole numbers, -1 where a span isn't 1 to 18 digits (a minus sign may stand before). Escapes count as what they stand for."""
    odd = np.flatnonzero(escaped(data, start, end))
    if len(odd):
        words = [decoded(x) for x in gather(data, start[odd], end[odd]).to_pylist()]
        out = span_integer(data, start, np.where(escaped(data, start, end), start, end))
        out[odd] = [int(w) if re.fullmatch("-?[0-9]{1,18}", w) else -1 for w in words]
        return out
    value, good = np.zeros(len(start), np.int64), (end > start)
    minus = good.copy()
    minus[good] = data[start[good]] == ord("-")
    first = start + minus
    good &= (end - first >= 1) & (end - first <= 18)
    for i in range(int((end - first)[good].max(initial=0))):
        at = np.flatnonzero(good & (end - first > i))
        digit = data[first[at] + i].astype(np.int64) - 48
        value[at] = value[at] * 10 + digit
        good[at] = (digit >= 0) & (digit <= 9)
    return np.where(good, np.where(minus, -value, value), -1)


def _escapes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of characters behind an escaping backslash, and of those backslashes."""
    slash = np.flatnonzero(data == 92)
    if not len(slash):
        return slash, slash
    new = np.ones(len(slash), bool)
    new[1:] = np.diff(slash) != 1
    if len(starts):  # a run of backslashes ends with its row
        row = np.searchsorted(starts, slash, "right")
        new[1:] |= row[1:] != row[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(slash)), 0))
    escaping = slash[(np.arange(len(slash)) - first) % 2 == 0]
    if len(starts):  # one at a row's end escapes nothing; its string is cut off anyway
        escaping = escaping[~np.isin(escaping + 1, starts)]
    return escaping + 1, escaping


def _classify_scalars(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """State of the scalar automaton behind each span; 0: no JSON scalar."""
    state = np.ones(len(start), np.uint8)
    at, i = np.arange(len(start)), 0
    while len(at):
        at = at[(start[at] + i < end[at]) & (state[at] > 0)]
        state[at] = _STEP[state[at], data[start[at] + i]]
        i += 1
    return np.where(_ACCEPT[state], state, 0)


def index(column: pa.Array, by_line: bool = False) -> Tokens:
    """Tokens of a string column.

    by_line: a string cannot go over a line's end, so that whole objects behind a cut-off one are found.
    """
    data, starts, ends = text_buffers(column)
    rows = len(starts)
    classes = _CLASS[data]
    if not by_line:
        classes[classes == LINE] = 0
    pos = np.flatnonzero(classes)
    kind = classes[pos]
    after, escaping = _escapes(data, starts)
    if len(after):
        quoted = pos[kind == QUOTE]
        drop = np.zeros(len(pos), bool)
        drop[np.flatnonzero(kind == QUOTE)[np.isin(quoted, after)]] = True
        pos, kind = pos[~drop], kind[~drop]
    doc = np.searchsorted(ends, pos, "right")
    quotes = np.cumsum(kind == QUOTE)
    before = np.concatenate([[0], quotes])
    base = before[np.searchsorted(pos, starts)] if rows else np.zeros(0, np.int64)
    start_of = base[doc] if len(pos) else np.zeros(0, np.int64)
    if by_line:
        start_of = np.maximum(start_of, np.maximum.accumulate(np.where(kind == LINE, quotes, 0)))
    inside = ((quotes - start_of) & 1).astype(bool)
    row_quotes = before[np.searchsorted(pos, ends)] - base if rows else np.zeros(0, np.int64)

    opening = (kind == QUOTE) & inside
    keep = np.flatnonzero(opening | ((kind != QUOTE) & ~inside & (kind != LINE)))
    token_kind, token_start = kind[keep].copy(), pos[keep]
    token_end = token_start + 1
    strings = np.flatnonzero(token_kind == QUOTE)
    # a string ends at the next quote; all between is dropped as it lies inside
    closing = pos[(kind == QUOTE) & ~inside]
    if len(strings):
        at = np.searchsorted(closing, token_start[strings], "right")
        end = np.where(at < len(closing), closing[np.minimum(at, len(closing) - 1)] + 1 if len(closing) else 0, -1)
        limit = ends[doc[keep[strings]]]
        closed = (end > 0) & (end <= limit)
        if by_line:
            lines = pos[kind == LINE]
            if len(lines):
                to = np.searchsorted(lines, token_start[strings], "right")
                line_end = np.where(to < len(lines), lines[np.minimum(to, len(lines) - 1)], len(data))
                closed &= end <= line_end
                limit = np.minimum(limit, line_end)
        token_end[strings] = np.where(closed, end, limit)
        token_kind[strings] = STRING
    token_ok = np.ones(len(keep), bool)
    if len(strings):
        token_ok[strings] = closed
    token_doc = doc[keep]

    # bare scalars: what isn't blank between two tokens
    blank = _SPACE[data]
    solid = np.flatnonzero(~blank)
    count = np.cumsum(~blank)
    first_of = np.searchsorted(token_doc, np.arange(rows))
    last_of = np.searchsorted(token_doc, np.arange(rows), "right")
    gap_from = np.concatenate([token_end, starts])
    follows = np.empty(len(keep), np.int64)
    if len(keep):
        follows[:-1] = token_start[1:]
        follows[-1] = len(data)
        follows = np.minimum(follows, ends[token_doc])
    lead = np.where(first_of < last_of, token_start[np.minimum(first_of, max(len(keep) - 1, 0))] if len(keep) else 0, ends)
    gap_to = np.concatenate([follows, lead])
    gap_doc = np.concatenate([token_doc, np.arange(rows)])
    upto = lambda p: np.where(p > 0, count[np.maximum(p, 1) - 1] if len(count) else 0, 0)
    n_from, n_to = upto(gap_from), upto(gap_to)
    full = np.flatnonzero((n_to > n_from) & (gap_to > gap_from))
    s_start, s_end = (solid[n_from[full]], solid[n_to[full] - 1] + 1) if len(full) else (np.zeros(0, np.int64),) * 2
    state = _classify_scalars(data, s_start, s_end)

    all_start = np.concatenate([token_start, s_start])
    order = np.argsort(all_start, kind="stable")
    t_kind = np.concatenate([token_kind, np.full(len(full), SCALAR, np.uint8)])[order]
    t_start, t_end = all_start[order], np.concatenate([token_end, s_end])[order]
    t_doc = np.concatenate([token_doc, gap_doc[full]])[order]
    t_state = np.concatenate([np.zeros(len(keep), np.uint8), state])[order]
    ok = np.concatenate([token_ok, state > 0])[order]
    n = len(order)

    # escapes and control characters, all inside strings here
    flaws = [np.flatnonzero(data < 32)]
    if len(escaping):
        code = data[np.minimum(after, len(data) - 1)]
        wrong = (after >= len(data)) | ~_ESCAPABLE[code]
        u = np.flatnonzero((code == ord("u")) & ~wrong)
        if len(u):
            hexes = after[u][:, None] + np.arange(1, 5)
            wrong[u] = (hexes >= len(data)).any(1) | ~_HEX[data[np.minimum(hexes, len(data) - 1)]].all(1)
        flaws.append(escaping[wrong])
    flaws = np.concatenate(flaws)
    if len(flaws) and n:
        owner = np.searchsorted(t_start, flaws, "right") - 1
        hit = (owner >= 0) & (flaws < t_end[np.maximum(owner, 0)])
        hit &= t_kind[np.maximum(owner, 0)] == STRING
        ok[owner[hit]] = False

    # depth by prefix sums; a token's container is the last bracket opened one level above it
    opens, closes = (t_kind == OBJ) | (t_kind == ARR), (t_kind == OBJ_END) | (t_kind == ARR_END)
    depth = np.cumsum(opens.astype(np.int64) - closes)
    row_first = np.searchsorted(t_doc, np.arange(rows))
    row_last = np.searchsorted(t_doc, np.arange(rows), "right")
    depth_before = np.concatenate([[0], depth])
    level = depth - depth_before[row_first][t_doc] if n else depth
    lowest = np.zeros(rows, np.int64)
    if n:
        np.minimum.at(lowest, t_doc[closes], level[closes])
    outer = level - opens  # level of the container a token stands in; a closing bracket counts as outside
    own = level + closes  # level of the container that a bracket opens or closes
    # place in order of (row, level): brackets mark where containers begin and end
    span = int(own.max(initial=0) - own.min(initial=0)) + 2
    brackets = np.flatnonzero(opens | closes)
    by = brackets[np.argsort((t_doc[brackets] * span + own[brackets] - own.min(initial=0)), kind="stable")]
    match = np.full(n, -1, np.int64)
    if len(by) > 1:
        a, b = by[:-1], by[1:]
        pair = opens[a] & closes[b] & (t_doc[a] == t_doc[b]) & (own[a] == own[b]) & ((t_kind[b] - t_kind[a]) == 1)
        match[a[pair]], match[b[pair]] = b[pair], a[pair]
    container = np.full(n, -1, np.int64)
    if n:
        low = outer.min()
        key_open = t_doc[opens] * (span + 1) + own[opens] - low
        key_all = t_doc * (span + 1) + outer - low
        at_open = np.flatnonzero(opens)
        rank = np.lexsort((np.concatenate([at_open, np.arange(n)]), np.concatenate([key_open, key_all])))
        # markers come before the tokens behind them; an opening bracket's own marker has another level
        marker = rank < len(at_open)
        last = np.maximum.accumulate(np.where(marker, np.arange(len(rank)), -1))
        place = np.flatnonzero(~marker)
        token = rank[place] - len(at_open)
        from_marker = np.where(last[place] >= 0, last[place], 0)
        found = at_open[np.minimum(rank[from_marker], len(at_open) - 1)] if len(at_open) else np.zeros(len(place), np.int64)
        good = (last[place] >= 0) & (len(at_open) > 0)
        if len(at_open):
            good &= (t_doc[found] == t_doc[token]) & (own[found] == outer[token]) & (found < token)
        container[token] = np.where(good, found, -1)

    previous = np.full(n, 0, np.uint8)
    following = np.full(n, 0, np.uint8)
    if n > 1:
        same = t_doc[1:] == t_doc[:-1]
        previous[1:] = np.where(same, t_kind[:-1], 0)
        following[:-1] = np.where(same, t_kind[1:], 0)
    around = np.where(container >= 0, t_kind[np.maximum(container, 0)], 0) if n else np.zeros(0, np.uint8)
    value_like = (t_kind == STRING) | (t_kind == SCALAR) | opens
    is_key = (t_kind == STRING) & (around == OBJ) & ((previous == OBJ) | (previous == COMMA)) & (following == COLON)
    in_obj = value_like & (around == OBJ) & (previous == COLON)
    in_arr = value_like & (around == ARR) & ((previous == ARR) | (previous == COMMA))
    at_top = value_like & (around == 0) & (previous == 0)
    is_value = in_obj | in_arr | at_top
    ends_value = (previous == STRING) | (previous == SCALAR) | (previous == OBJ_END) | (previous == ARR_END)
    prev_key = np.zeros(n, bool)
    prev_key[1:] = is_key[:-1]
    ok &= np.select(
        [value_like, t_kind == COLON, t_kind == COMMA, t_kind == OBJ_END, t_kind == ARR_END],
        [is_value | is_key, prev_key, ends_value & ~prev_key & (around > 0), ((previous == OBJ) | (ends_value & ~prev_key)) & (match >= 0), ((previous == ARR) | ends_value) & (match >= 0)],
        False,
    )
    # place among the members: commas of the same container before it
    item = np.full(n, -1, np.int64)
    commas = np.flatnonzero((t_kind == COMMA) & (container >= 0))
    members = np.flatnonzero(is_value & (container >= 0))
    if len(members):
        both = np.concatenate([commas, members])
        rank = np.lexsort((both, container[both]))
        total = np.cumsum(rank < len(commas))
        group_first = np.searchsorted(container[both][rank], container[members])
        start_count = np.concatenate([[0], total])[group_first]
        place = np.empty(len(both), np.int64)
        place[rank] = total
        item[members] = place[len(commas) :] - start_count
    key = np.full(n, -1, np.int64)
    fields = np.flatnonzero(in_obj)
    key[fields] = fields - 2

    flawed = np.zeros(rows, bool)
    flawed[t_doc[~ok]] = True
    tops = np.bincount(t_doc[value_like & (container < 0)], minlength=rows) if n else np.zeros(rows, np.int64)
    final = depth_before[row_last] - depth_before[row_first] if rows else np.zeros(0, np.int64)
    valid = ~flawed & (tops == 1) & (final == 0) & (lowest == 0) & (by_line | (row_quotes % 2 == 0))
    if n:
        unmatched = opens & (match < 0)
        valid[t_doc[unmatched]] = False
    return Tokens(data, t_kind, t_doc, t_start, t_end, container, item, key, match, ok, t_state, is_key, is_value, valid)


def type_names(t: Tokens, at: np.ndarray) -> np.ndarray:
    """JSON type of value tokens: object, array, string, integer, number, boolean or null."""
    names = np.select([t.kind[at] == OBJ, t.kind[at] == ARR, t.kind[at] == STRING], ["object", "array", "string"], "")
    bare = t.kind[at] == SCALAR
    names = names.astype("U8")
    names[bare] = _KIND[t.scalar[at[bare]]]
    return names


def value_spans(t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of values: a bracket's goes to its other bracket."""
    end = np.where(t.match[at] > at, t.end[np.maximum(t.match[at], 0)], t.end[at])
    return t.start[at], end


def inner_spans(t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As value_spans, but strings without their quotes."""
    start, end = value_spans(t, at)
    text = t.kind[at] == STRING
    return start + text, end - text
