"""Secret scans by multipart credential linking, in DataFrame functions only.

Strong candidates are the base kinds: keyword assignments, access identifiers
and long hexadecimal runs. Weak candidates, a random-looking token without a
keyword or an endpoint, are reported only when a complementary part lies within
`scope` code points of them: an access identifier for a token, an access
identifier or an assignment for an endpoint. The interval join runs inside the
row: parts are sorted by their start, and two sweeps over them, one each way,
tell which weak ones have an anchor near. It needs no shuffle, and a part costs
the sort and two steps. What a fold gathers is held in blocks, so that a step
does not copy all that was gathered before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import project

#: Fixed patterns of the base kinds, in the order that breaks ties of start.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak kinds.
TOKEN = r"[A-Za-z0-9+/]{32,}"
#: A scheme has 16 characters at most, so that a long run of letters is not read again from each of them.
ENDPOINT = r"[a-z][a-z0-9+.-]{0,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "token", "endpoint")
SPAN = "array<struct<start:int,end:int,kind:int>>"
#: Entries that a fold gathers before it closes a block; code points in a piece of a text.
BLOCK, PIECE = 256, 4096


def gathered(items: str, state: str, step: str, entry: str, kind: str) -> str:
    """SQL: the entries of a fold over `items`, in order.

    `state` is the fold's first state, `step` its next one and `entry` what it
    adds (null: nothing), both from state `s.st` and item `x`.
    """
    empty = f"CAST(array() AS array<{kind}>)"
    return f"""flatten(aggregate({items},
      named_struct('st', {state}, 'done', CAST(array() AS array<array<{kind}>>), 'part', {empty}),
      (s, x) -> named_struct(
        'st', {step},
        'done', IF(size(s.part) >= {BLOCK}, array_append(s.done, s.part), s.done),
        'part', IF(size(s.part) >= {BLOCK}, filter(array({entry}), e -> e IS NOT NULL), IF(({entry}) IS NULL, s.part, array_append(s.part, {entry})))),
      s -> array_append(s.done, s.part)))"""


def _matches(text: str, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches as structs (start, end, kind, found), in code points.

    The pieces between matches give the places: match i starts after i + 1
    pieces and i matches. Texts without a match skip the fold.
    """
    k = KINDS.index(kind)
    found = "struct<start:int,end:int,kind:int,found:string>"
    entry = f"IF(x.`1` IS NULL, NULL, named_struct('start', s.st + length(x.`0`), 'end', s.st + length(x.`0`) + length(x.`1`), 'kind', {k}, 'found', x.`1`))"
    parts = f"arrays_zip(split({text}, r'''{pattern}''', -1), regexp_extract_all({text}, r'''{pattern}''', 0))"
    fold = gathered(parts, "0", "s.st + length(x.`0`) + coalesce(length(x.`1`), 0)", entry, found)
    return F.expr(_quoted(f"CASE WHEN {text} RLIKE r'''{pattern}''' THEN {fold} ELSE CAST(array() AS array<{found}>) END", pattern))


def _quoted(sql: str, pattern: str) -> str:
    """Puts the pattern in as an ordinary SQL string, whatever quotes and backslashes it has."""
    literal = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return sql.replace(f"r'''{pattern}'''", literal)


def _near(weak: str, anchors: str, scope: int) -> Column:
    """Of the spans `weak`, those within `scope` of one of `anchors`: a sweep by start sees the anchors before, one back those after."""
    item = lambda w: f"x -> named_struct('start', x.start, 'weak', {w}, 'end', x.end, 'kind', x.kind)"
    both = f"array_sort(concat(transform({anchors}, {item('false')}), transform({weak}, {item('true')})))"
    none = "CAST(NULL AS int)"
    ahead = gathered("items", none, "IF(x.weak, s.st, greatest(s.st, x.end))", f"coalesce(x.weak AND x.start - s.st <= {scope}, false)", "boolean")
    back = gathered("reverse(items)", none, "IF(x.weak, s.st, x.start)", f"coalesce(x.weak AND s.st - x.end <= {scope}, false)", "boolean")
    kept = "transform(filter(arrays_zip(items, AHEAD, reverse(BACK)), z -> z.`1` OR z.`2`), z -> named_struct('start', z.items.start, 'end', z.items.end, 'kind', z.items.kind))"
    kept = kept.replace("AHEAD", ahead).replace("BACK", back)
    return F.expr(f"IF(size({weak}) = 0 OR size({anchors}) = 0, CAST(array() AS {SPAN}), transform(array({both}), items -> {kept})[0])")


def _sorted(*spans: str) -> Column:
    """The spans of several arrays by start, then kind."""
    keyed = F.array_sort(F.transform(F.concat(*spans), lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))))
    return F.transform(keyed, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind")))


def _scan(d: DataFrame, scope: int) -> DataFrame:
    """`d` is (row, text without nulls); adds base and spans."""
    plain = lambda c: F.transform(c, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind")))
    d = d.select("row", "text", *[_matches("text", p, k).alias(f"m_{k}") for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN), ("endpoint", ENDPOINT))])
    found = d.select(
        "row",
        "text",
        plain(F.filter("m_assign", lambda x: F.length(F.regexp_extract(x.found, ASSIGN, 2)) >= MIN_ASSIGNED)).alias("assign"),
        plain("m_access").alias("access"),
        plain("m_hex").alias("hex"),
        # upper and lower case and a digit: a word or a path is no token
        plain(F.filter("m_token", lambda x: x.found.rlike("[a-z]") & x.found.rlike("[A-Z]") & x.found.rlike("[0-9]"))).alias("token"),
        plain("m_endpoint").alias("endpoint"),
    )
    linked = found.select("row", "text", "assign", "access", "hex", _near("token", "access", scope).alias("token"), _near("endpoint", "concat(access, assign)", scope).alias("endpoint"))
    return linked.select("row", "text", _sorted("assign", "access", "hex").alias("base"), _sorted("assign", "access", "hex", "token", "endpoint").alias("spans"))


def redact(docs: DataFrame, scope: int = 256, mask: str = "[SECRET]") -> DataFrame:
    """The documents, all columns as they are, with every span of `scan` replaced by `mask`; n_chars, if there, is counted anew.

    A null text stays null. Rows that repeat stay.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    out = _scan(packed, scope).select("row", redacted(mask).alias("text"))
    at = names.index("text")
    text = F.when(F.col(f"row.c{at}").isNotNull(), F.col("text"))
    new = {"text": text, "n_chars": F.length(text)}
    kinds = dict(docs.dtypes)
    return out.select(*[new[c].cast(kinds[c]).alias(c) if c in new else F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])


def scan(docs: DataFrame, scope: int = 256) -> DataFrame:
    """The input's rows as (doc_id, text, base, spans): arrays of (start, end, kind number), by start, then kind.

    Places are code points, ends exclusive. A null text counts as empty and has
    no spans. Rows that repeat stay; empty tables give none; other columns are
    not read. No shuffle: every row is scanned where it is read.
    """
    d = project(docs, doc_id="long", text="string").select(F.col("doc_id").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return _scan(d, scope).withColumnRenamed("row", "doc_id")


def spelled(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start, x.end)), ",")


def counted(found: DataFrame) -> DataFrame:
    """Digest columns of `scan`: counts of the base kinds, a SHA-256 of the base spans, all spans."""
    n = lambda k: F.size(F.filter("base", lambda x: x.kind == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


def redacted(mask: str = "[SECRET]") -> Column:
    """The column `text` with every stretch covered by the column `spans` replaced by `mask`."""
    # stretches that no span covers, from the end of those before to a start; the last one ends the text
    merged = gathered("spans", "0", "greatest(s.st, x.end)", "IF(x.start >= s.st, named_struct('a', s.st, 'b', x.start), NULL)", "struct<a:int,b:int>")
    piece = lambda at: f"coalesce(get(t.pieces, {at}), '')"
    first, last = f"g.a div {PIECE}", f"g.b div {PIECE}"
    within = f"substring({piece(f'int({first})')}, g.a % {PIECE} + 1, g.b - g.a)"
    across = f"concat(substring({piece(f'int({first})')}, g.a % {PIECE} + 1), array_join(slice(t.pieces, int({first}) + 2, greatest(int({last} - {first}) - 1, 0)), ''), substring({piece(f'int({last})')}, 1, g.b % {PIECE}))"
    gaps = f"transform({merged}, g -> IF({first} = {last}, {within}, {across}))"
    end = "aggregate(spans, 0, (s, x) -> greatest(s, x.end))"
    tail = f"transform(array(named_struct('a', {end}, 'b', length(text))), g -> IF({first} = {last}, {within}, {across}))[0]"
    # texts are cut once, so that a stretch is found without a walk from the text's start
    cut = f"array(named_struct('pieces', regexp_extract_all(text, '(?s).{{1,{PIECE}}}', 0)))"
    return F.expr(f"IF(size(spans) = 0, text, transform({cut}, t -> concat(array_join({gaps}, '{mask}'), '{mask}', {tail}))[0])")


def oracle(scope: int = 256) -> str:
    """The digest columns in DuckDB SQL, written on its own lists and joins."""

    def spans(pattern: str, keep: str = "true") -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        return f"""(SELECT coalesce(list(struct_pack(s := s, e := e) ORDER BY s), []) FROM (
            SELECT m, e - length(m) AS s, e FROM (
              SELECT m, i, sum(length(g) + length(m)) OVER (ORDER BY i) AS e FROM (
                SELECT unnest(regexp_extract_all(t, {p})) AS m, unnest((string_split_regex(t, {p}))[:-2]) AS g, generate_subscripts(regexp_extract_all(t, {p}), 1) AS i)))
            WHERE {keep})"""

    return f"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      f AS (SELECT doc_id,
          {spans(ASSIGN, "length(regexp_extract(m, '" + ASSIGN.replace("'", "''") + f"', 2)) >= {MIN_ASSIGNED}")} AS a,
          {spans(ACCESS)} AS c, {spans(HEX)} AS h,
          {spans(TOKEN, "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')")} AS tk,
          {spans(ENDPOINT)} AS ep FROM d),
      n AS (SELECT doc_id, a, c, h,
          list_filter(tk, lambda w: len(list_filter(c, lambda x: x.s - w.e <= {scope} AND w.s - x.e <= {scope})) > 0) AS tk,
          list_filter(ep, lambda w: len(list_filter(list_concat(c, a), lambda x: x.s - w.e <= {scope} AND w.s - x.e <= {scope})) > 0) AS ep FROM f),
      r AS (SELECT doc_id, len(a)::BIGINT AS n_assign, len(c)::BIGINT AS n_access, len(h)::BIGINT AS n_hex,
          list_concat(list_transform(a, lambda x: {{'s': x.s, 'k': 0, 'n': 'assign:' || x.s || ':' || x.e}}),
            list_transform(c, lambda x: {{'s': x.s, 'k': 1, 'n': 'access:' || x.s || ':' || x.e}}),
            list_transform(h, lambda x: {{'s': x.s, 'k': 2, 'n': 'hex:' || x.s || ':' || x.e}})) AS b,
          list_concat(list_transform(tk, lambda x: {{'s': x.s, 'k': 3, 'n': 'token:' || x.s || ':' || x.e}}),
            list_transform(ep, lambda x: {{'s': x.s, 'k': 4, 'n': 'endpoint:' || x.s || ':' || x.e}})) AS w FROM n)
      SELECT doc_id, n_assign, n_access, n_hex,
        sha256(coalesce(array_to_string(list_transform(list_sort(b), lambda x: x.n), ','), '')) AS base_sha256,
        coalesce(array_to_string(list_transform(list_sort(list_concat(b, w)), lambda x: x.n), ','), '') AS spans
      FROM r"""
