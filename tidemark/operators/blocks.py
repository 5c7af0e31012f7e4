"""JSON-LD blocks (N01-N03, E14), of any depth that the JSON reader takes (1,000 levels).

`walk_types` reads each block once, in tasks that get blocks as Arrow batches.  `read`, of which page rows are made, needs no
Python: it is a walk by levels in column expressions.  A level reads again what the one above it has read, and what a page
says is short; where blocks are the bulk of the data the Arrow walk takes a small part of the time.

In `read`, a level holds the texts of objects and lists.  Each is read twice, as texts by key (in the order of the text, which a variant
loses) and as variants, which tell a text that looks like an object from an object.  The next level is what is within.  There
are as many levels as brackets are open at once outside of texts; nothing is shuffled, and a page's blocks are never apart
from its row."""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types whose name is the site's.
NAMED = ["Organization", "LocalBusiness", "WebSite"]
#: Levels that the JSON reader takes; what is deeper does not parse.
DEEPEST = 1000
_STRICT = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"
_NODE = "array<struct<path: array<int>, text: string>>"
_FOUND = "array<struct<path: array<int>, text: string, types: array<string>, name: string>>"


def _let(name: str, value: str, body: str) -> str:
    """body with value computed once: a lambda's variable is not computed again where it is read."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _json(text: str, kind: str) -> str:
    return f"from_json({text}, '{kind}', {_STRICT})"


def _kind(x: str) -> str:
    """The first sign of a value (text, v) as JSON, which tells what it is; where keys repeat there is no variant, and the
    text itself tells."""
    return f"""if({x}.v IS NULL, CASE WHEN {x}.text IS NULL THEN 'n' WHEN left({x}.text, 1) IN ('{{', '[') THEN left({x}.text, 1) ELSE '"' END, left(to_json({x}.v), 1))"""


def _said(x: str) -> str:
    """A value (text, v) as a web script shows it as text."""
    number = f"CASE WHEN abs(try_cast({x}.text AS DOUBLE)) < 1e21 AND try_cast({x}.text AS DOUBLE) = floor(try_cast({x}.text AS DOUBLE)) THEN cast(cast({x}.text AS DECIMAL(38, 0)) AS STRING) ELSE {x}.text END"
    listed = f"array_join({_json(f'{x}.text', 'array<string>')}, ',', '')"
    return _let("s", _kind(x), f"""CASE s WHEN 'n' THEN 'null' WHEN '{{' THEN '[object Object]' WHEN '[' THEN {listed} WHEN '"' THEN {x}.text WHEN 't' THEN 'true' WHEN 'f' THEN 'false' ELSE {number} END""")


def _counts(x: str) -> str:
    """Whether a script takes the value as true."""
    return _let("s", _kind(x), f"""{x} IS NOT NULL AND coalesce(CASE s WHEN 'n' THEN false WHEN 'f' THEN false WHEN '"' THEN {x}.text <> '' WHEN 't' THEN true WHEN '{{' THEN true WHEN '[' THEN true ELSE try_cast({x}.text AS DOUBLE) <> 0 END, false)""")


def _opens(x: str) -> str:
    """Whether the value is an object or a list: only a text that looks like one asks for its kind."""
    return f"(left({x}.text, 1) IN ('{{', '[') AND {_kind(x)} <> '\"')"


def _entry(key: str, text: str, variant: str) -> str:
    """What is within an object or a list."""
    return f"named_struct('key', {key}, 'text', {text}, 'v', {variant})"


def _elements(text: str) -> str:
    """The values of a list."""
    read = f"named_struct('a', {_json(text, 'array<string>')}, 'b', {_json(text, 'array<variant>')})"
    return _let("l", read, f"coalesce(transform(l.a, (t, i) -> {_entry('cast(null AS STRING)', 't', 'get(l.b, i)')}), array())")


def _members(text: str) -> str:
    """The values of an object: of a key that repeats the last one, at the place of the first; whole numbers come before all
    other keys."""
    read = f"named_struct('m', {_json(text, 'map<string,string>')}, 'v', {_json(text, 'map<string,variant>')})"
    plain = _let("o", read, f"coalesce(transform(map_keys(o.m), (k, i) -> {_entry('k', 'get(map_values(o.m), i)', 'get(map_values(o.v), i)')}), array())")
    keys = "transform(e, x -> x.key)"
    once = _let("e", plain, f"if(size(array_distinct({keys})) = size(e), e, transform(array_distinct({keys}), k -> element_at(filter(e, x -> x.key = k), -1)))")
    number = "x.key RLIKE '^(0|[1-9][0-9]{0,9})$'"
    places = f"filter(transform(d, (x, i) -> if({number}, named_struct('n', cast(x.key AS BIGINT), 'i', i), null)), y -> y IS NOT NULL)"
    first = f"transform(array_sort({places}), y -> get(d, y.i))"
    return _let("d", once, f"if(exists(d, x -> {number}), concat({first}, filter(d, x -> NOT ({number}))), d)")


@lru_cache(maxsize=2)
def _walk() -> tuple[str, str]:
    """SQL over a text `raw`: whether it is JSON, and its typed objects.

    Spark reads a value and leaves what follows it, so the block is put between two keys, the second of which no block can
    hold; both, and only they, must be there."""
    whole = """concat('{"v":', raw, ',"', md5(raw), '":0}')"""
    outer = f"named_struct('m', {_json(whole, 'map<string,string>')}, 'v', {_json(whole, 'map<string,variant>')})"
    valid = f"coalesce(map_keys({_json(whole, 'map<string,string>')}) = array('v', md5(raw)), false)"
    # the first level: the block itself, if it is an object or a list
    root = _let("r", outer, f"if(map_keys(r.m) = array('v', md5(raw)), {_entry(chr(39) + 'v' + chr(39), 'map_values(r.m)[0]', 'get(map_values(r.v), 0)')}, null)")
    level = f"cast(transform(filter(array({root}), x -> x IS NOT NULL AND {_opens('x')}), x -> named_struct('path', array(), 'text', x.text)) AS {_NODE})"
    # a level: what is within each node
    opened = f"transform(acc.level, n -> named_struct('path', n.path, 'text', n.text, 'e', if(left(n.text, 1) = '{{', {_members('n.text')}, {_elements('n.text')})))"
    kinds = f"CASE WHEN NOT {_counts('t')} THEN array() WHEN {_kind('t')} = '[' THEN transform({_elements('t.text')}, y -> {_said('y')}) ELSE array({_said('t')}) END"
    kind = _let("t", "get(filter(z.e, x -> x.key = '@type'), 0)", f"cast({kinds} AS array<string>)")
    name = _let("t", "get(filter(z.e, x -> x.key = 'name'), 0)", f"if({_counts('t')}, {_said('t')}, '')")
    typed = f"transform(filter(p, z -> exists(z.e, x -> x.key = '@type')), z -> named_struct('path', z.path, 'text', z.text, 'types', {kind}, 'name', {name}))"
    inner = f"flatten(transform(p, z -> transform(filter(transform(z.e, (x, i) -> named_struct('i', i, 'text', x.text, 'v', x.v)), x -> {_opens('x')}), x -> named_struct('path', concat(z.path, array(x.i)), 'text', x.text))))"
    step = _let("p", opened, f"named_struct('level', cast({inner} AS {_NODE}), 'found', concat(acc.found, cast(filter({typed}, x -> size(x.types) > 0) AS {_FOUND})))")
    # the levels there are: the deepest place among the brackets outside of texts
    brackets = r"""regexp_replace(regexp_replace(raw, r'(?s)"(?:[^"\\]++|\\.)*+"', ''), r'[^{}\[\]]', '')"""
    deeper = "if(c IN ('{', '['), named_struct('d', a.d + 1, 'm', greatest(a.m, a.d + 1)), named_struct('d', a.d - 1, 'm', a.m))"
    depth = f"coalesce(aggregate(filter(split({brackets}, ''), c -> c <> ''), named_struct('d', 0, 'm', 0), (a, c) -> {deeper}, a -> a.m), 0)"
    rounds = _let("most", depth, f"if(most = 0, cast(array() AS array<int>), sequence(1, least({DEEPEST}, most)))")
    start = f"named_struct('level', {level}, 'found', cast(array() AS {_FOUND}))"
    return valid, f"aggregate({rounds}, {start}, (acc, round) -> if(size(acc.level) = 0, acc, {step}), acc -> array_sort(acc.found))"


def read(blocks: str) -> Column:
    """For the blocks of a page (a column of texts): which are valid, the distinct types in order of first sight, and the
    site's name."""
    valid, found = _walk()
    each = f"transform(coalesce({blocks}, array()), raw -> named_struct('valid', {valid}, 'found', {found}))"
    names = ", ".join(f"'{x}'" for x in NAMED)
    all_found = "flatten(transform(b, x -> x.found))"
    named = f"coalesce(get(filter({all_found}, x -> x.types[0] IN ({names})), 0).name, '')"
    return F.expr(_let("b", each, f"named_struct('valid', transform(b, x -> x.valid), 'types', array_distinct(flatten(transform({all_found}, x -> x.types))), 'name', {named})"))


#: A text, or a sign that begins or ends an object.
_SIGNS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}]', re.S)
#: A number that the JSON reader takes for too long, and texts, in which there may be such digits.
_LONG, _TEXTS = re.compile(r"[0-9][-+.eE0-9]{1000}"), re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: What a written value is made of besides signs and words; characters that the JSON reader writes as escapes.
_PARTS, _WIDE = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|-?Infinity|-?[0-9][-+.e0-9]*', re.S), re.compile("[\ud800-\udfff\U00010000-\U0010ffff]")
_WHOLE = re.compile("0|[1-9][0-9]{0,9}").fullmatch


def _refuse(said: str) -> None:
    raise ValueError(said)


_decode = json.JSONDecoder(parse_constant=_refuse).decode


def _digits(x: float) -> str:
    """A number with a fraction as the JSON reader writes it."""
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x)
    minus, digits, power = Decimal(repr(x)).normalize().as_tuple()
    first, *rest = map(str, digits)
    return f"{'-' * minus}{first}.{''.join(rest) or '0'}E{power + len(rest)}"


def _as_written(part: re.Match) -> str:
    """A text or number of written JSON as the JSON reader writes it."""
    said = part[0]
    if said[0] == '"':
        return _WIDE.sub(lambda c: re.sub("(.{4})", r"\\u\1", c[0].encode("utf-16-be", "surrogatepass").hex().upper()), said)
    if said.endswith("y"):
        return f'"{said}"'
    return said if said.removeprefix("-").isdecimal() else _digits(float(said))


def _text(x) -> str:
    """A value as a list of texts has it."""
    if x is None or isinstance(x, str):
        return x or ""
    return _digits(x) if isinstance(x, float) else _PARTS.sub(_as_written, json.dumps(x, separators=(",", ":"), ensure_ascii=False))


def _shown(x) -> str:
    """A value as a web script shows it as text."""
    if x is None:
        return "null"
    if isinstance(x, dict):
        return "[object Object]"
    if isinstance(x, list):
        return ",".join(map(_text, x))
    return str(int(Decimal(repr(x)))) if isinstance(x, float) and abs(x) < 1e21 and x.is_integer() else _text(x)


def _objects(raw: str, spans: bool) -> list[tuple[tuple[int, ...], list[str], int, int]]:
    """The typed objects of a block: place, types and, if asked for, first sign and length; nothing if it is not JSON.

    Of a key that repeats the last value counts, at the place of the first, and whole numbers come before all other keys."""
    ended: list[dict] = []
    try:
        whole = json.JSONDecoder(parse_constant=_refuse, object_hook=lambda x: ended.append(x) or x).decode(raw) if spans else _decode(raw)
    except (ValueError, RecursionError):
        return []
    if len(raw) > 1000 and _LONG.search(raw) and _LONG.search(_TEXTS.sub('""', raw)):
        return []
    found, left = [], [((), whole)] if type(whole) in (dict, list) else []
    while left:
        path, node = left.pop()
        if len(path) >= DEEPEST - 1:
            return []
        if type(node) is dict:
            kind = node.get("@type")
            if kind or type(kind) in (dict, list):
                kinds = [kind] if type(kind) is str else [_shown(x) for x in (kind if type(kind) is list else [kind])]
                if kinds:
                    found.append((path, kinds, node))
            inside = list(node.values())
            if any(map(_WHOLE, node)):
                first = sorted((k for k in node if _WHOLE(k)), key=int)
                inside = [node[k] for k in first] + [x for k, x in node.items() if not _WHOLE(k)]
        else:
            inside = node
        below = [((*path, k), x) for k, x in enumerate(inside) if type(x) is dict or type(x) is list]
        left.extend(reversed(below))
    if not spans:
        return [(path, kinds, 0, 0) for path, kinds, _ in found]
    # objects are read in the order of their ends, also those of a key that repeats
    opened, places = [], []
    for sign in _SIGNS.finditer(raw):
        if sign[0] == "{":
            opened.append(sign.start())
        elif sign[0] == "}":
            start = opened.pop()
            places.append((start + 1, sign.end() - start))
    at = dict(zip(map(id, ended), places, strict=True))
    return [(path, kinds, *at[id(node)]) for path, kinds, node in found]


def _walked(raws: pa.Array, spans: bool) -> pa.Array:
    """For each block the list of its typed objects, one entry for each type."""
    ends, path_ends, places, types, starts, sizes = [0], [0], [], [], [], []
    for raw in raws.cast(pa.binary()):
        said = raw.as_py()
        for path, kinds, start, size in _objects(said.decode("utf-8", "replace"), spans) if said is not None else ():
            for kind in kinds:
                places.extend(path)
                path_ends.append(len(places))
                types.append(kind)
                starts.append(start)
                sizes.append(size)
        ends.append(len(types))
    # half of a surrogate pair has no bytes: a question mark, as in Java
    types = pa.array([t.encode("utf-8", "replace") for t in types], pa.binary()).cast(pa.string())
    paths = pa.ListArray.from_arrays(pa.array(path_ends, pa.int32()), pa.array(places, pa.int32()))
    columns = {"path": paths, "type": types, **({"start": pa.array(starts, pa.int32()), "size": pa.array(sizes, pa.int32())} if spans else {})}
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def walk_types(blocks: DataFrame, body: bool = True) -> DataFrame:
    """Blocks (page_url, raw, and block if there is one) to (page_url, block, path, type, body) for every object with
    @type and each of its types.  path is the place in the document: a parent comes before what is in it.  Blocks that do not
    parse give nothing.  The object's text costs a second look at the block, and can be left out."""
    block: Column = F.coalesce("block", F.lit(0)) if "block" in blocks.columns else F.lit(0)
    entry = f"array<struct<path: array<int>, type: string{', start: int, size: int' * body}>>"

    def walk(raws: pa.Array) -> pa.Array:
        return _walked(raws, body)

    read = F.arrow_udf(walk, entry)
    rows = blocks.select("page_url", block.alias("block"), "raw", read("raw").alias("x")).select("page_url", "block", "raw", F.explode("x").alias("x"))
    out = [F.col("page_url"), F.col("block"), F.col("x.path").alias("path"), F.col("x.type").alias("type")]
    if body:
        text = F.concat(F.lit('{"v":'), F.substring(F.col("raw"), F.col("x.start"), F.col("x.size")), F.lit("}"))
        out.append(F.try_element_at(F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}), F.lit("v")).alias("body"))
    return rows.select(*out)
