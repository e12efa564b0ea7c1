r"""Plain SQL twins of the corpus queries that SQL can express.

The others are tested against brute-force versions: suffix-array dedup (byte windows of
every text are beyond SQL's reach on whole tables), language identification (held-out
accuracy), HTML extraction, chat repair and BPE (exact round trip).
"""

from __future__ import annotations

from quintavote.llm import decontaminate, line_templates, part_codes, prefix_trie, quality_ledger, scaled_sketch

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _op2() -> str:
    bits = " + ".join(
        f"CASE WHEN {sql} THEN {quality_ledger.BITS[name]} ELSE 0 END"
        for name, sql in quality_ledger.RULES.items()
    )
    blank_line = f"length(translate(l, {_BLANKS}, '')) > 0"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, {_WORDS.format("t")} AS w,
         list_filter(string_split(t, chr(10)), lambda l: {blank_line}) AS l
  FROM d
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(translate(t, {_BLANKS}, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '{quality_ledger.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)
), f AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & {quality_ledger.BASE.mask} <> 0 AS base_failed,
       fail_bits & {quality_ledger.STANDARD.mask} = 0 AS kept, fail_bits
FROM f"""


def _op3() -> str:
    t = line_templates
    even = (
        r"trim(regexp_replace(translate(l, chr(9) || chr(11) || chr(12) || chr(13), '    '),"
        " ' {2,}', ' ', 'g'))"
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, coalesce(doc_id, 9223372036854775807) AS doc
  FROM documents
), l AS (
  SELECT r, doc, i, regexp_replace(e, '[^ ]*(?:[0-9@]|://)[^ ]*', '{t.FIELD}', 'g') AS line
  FROM (SELECT r, doc, i, {even} AS e
        FROM (SELECT r, doc, unnest(string_split(text, chr(10))) AS l,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d))
  WHERE e <> ''
), k AS (
  SELECT *, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n,
         string_split(line, ' ')[1:{t.DEPTH}] AS lead FROM l
), places AS (
  SELECT n, lead, p, count(DISTINCT tok) > {t.MAX_VALUES} AS field
  FROM (SELECT n, lead, unnest(w) AS tok, generate_subscripts(w, 1) AS p
        FROM (SELECT DISTINCT n, lead, line, w FROM k
              WHERE (n, lead) IN (SELECT (n, lead) FROM k GROUP BY n, lead
                                  HAVING count(DISTINCT doc) >= {t.MIN_DOCS})))
  GROUP BY n, lead, p
), fields AS (SELECT n, lead, list(p) AS fs FROM places WHERE field GROUP BY n, lead),
g AS (
  SELECT r, doc, i, line,
         CASE WHEN fs IS NULL THEN w
              ELSE list_transform(w, lambda x, j: CASE WHEN list_contains(fs, j) THEN '{t.FIELD}' ELSE x END)
         END AS gw
  FROM k LEFT JOIN fields USING (n, lead)
), tm AS (
  SELECT r, doc, i, CASE WHEN len(list_filter(gw, lambda x: x <> '{t.FIELD}')) >= {t.MIN_FIXED}
       AND len(list_filter(gw, lambda x: x <> '{t.FIELD}')) >= {t.MIN_SHARE} * len(gw)
       THEN array_to_string(gw, ' ') ELSE line END AS template
  FROM g
), rec AS (
  SELECT template, min(doc) AS first FROM tm GROUP BY template
  HAVING count(DISTINCT doc) >= {t.MIN_DOCS}
), gone AS (
  SELECT r, list(i) AS gone FROM tm JOIN rec USING (template) WHERE doc <> first GROUP BY r
)
SELECT doc_id, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS BIGINT) AS n_lines,
       CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       CASE WHEN gone IS NULL THEN text ELSE
         array_to_string(list_filter(string_split(text, chr(10)), lambda x, j: NOT list_contains(gone, j)), chr(10))
       END AS text
FROM d LEFT JOIN gone USING (r)"""


def _op6() -> str:
    c = decontaminate
    units = ", ".join(f"'{u}'" for u in c.UNITS)
    pattern = r"\p{N}+(?:[.,:/-]\p{N}+)*|[\p{L}\p{M}]+"
    number = r"regexp_matches({}, '^\p{{N}}')"
    def kinds(named: bool) -> str:
        name = " WHEN left(x, 1) <> lower(left(x, 1)) THEN '<name>'" if named else ""
        return (
            f"list_transform(t, lambda x, i: CASE WHEN {number.format('x')} THEN '<num>'{name}"
            f" WHEN x IN ({units}) AND i > 1 AND {number.format('t[i - 1]')} THEN '<unit>'"
            " ELSE lower(x) END)"
        )

    folded = "list_transform(t, lambda x: replace(replace(lower(x), 'ß', 'ss'), 'ς', 'σ'))"
    return f"""
WITH src AS (
  SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), tok AS (
  SELECT side, id, row_number() OVER () AS k, regexp_extract_all(text, '{pattern}') AS t FROM src
), forms AS (
  SELECT side, id, k, false AS folded, t FROM tok UNION ALL SELECT side, id, k, true, {folded} FROM tok
), kinds AS (
  SELECT *, CASE WHEN folded THEN {kinds(False)} ELSE {kinds(True)} END AS c FROM forms
), b AS (
  SELECT id, k, folded, t, c, least({c.WINDOW}, len(t)) AS size,
         unnest(generate_series(1, len(t) - least({c.WINDOW}, len(t)) + 1)) AS p
  FROM kinds WHERE side = 'b' AND len(t) > 0
), bw AS (
  SELECT id, k, folded, t, c, size, p, c[p:p + size - 1] AS w FROM b
  WHERE len(list_filter(c[p:p + size - 1], lambda x: x NOT LIKE '<%>')) >= least({c.MIN_WORDS}, size)
), dw AS (
  SELECT id, k, folded, t, a, c[a:a + size - 1] AS w, size
  FROM (SELECT id, k, folded, t, c, size, unnest(generate_series(1, len(t) - size + 1)) AS a
        FROM kinds, (SELECT DISTINCT size FROM bw) WHERE side = 'd' AND len(t) >= size)
), hit AS (
  SELECT dw.id AS doc_id, dw.k AS dk, bw.id AS item_id, bw.k AS bk, folded, bw.size, p, a,
         bw.t AS mine, bw.c AS c, dw.t AS theirs
  FROM dw JOIN bw USING (folded, w)
), slots AS (
  SELECT DISTINCT dk, bk, folded, a - p AS diagonal, mine[p + j] AS mine, theirs[a + j] AS theirs
  FROM (SELECT *, unnest(generate_series(0, size - 1)) AS j FROM hit) WHERE c[p + j] LIKE '<%>'
), bad AS (
  SELECT dk, bk, folded, diagonal, bool_or(mine <> theirs) AS other,
         count(DISTINCT mine) < count(*) OR count(DISTINCT theirs) < count(*) AS mixed
  FROM slots GROUP BY dk, bk, folded, diagonal
), per AS (
  SELECT doc_id, item_id, dk, bk, folded, count(DISTINCT p) AS n_hit, bool_or(coalesce(other, false)) AS other
  FROM (SELECT *, a - p AS diagonal FROM hit) LEFT JOIN bad USING (dk, bk, folded, diagonal)
  WHERE mixed IS NOT TRUE GROUP BY doc_id, item_id, dk, bk, folded
), total AS (SELECT k AS bk, folded, count(*) AS n_windows FROM bw GROUP BY k, folded),
best AS (
  SELECT doc_id, item_id, max({{'t': NOT folded, 'h': n_hit, 'w': n_windows, 'o': other}}) AS x
  FROM per JOIN total USING (bk, folded) WHERE n_hit >= {c.MIN_SHARE} * n_windows GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(x.w AS BIGINT) AS n_windows, CAST(x.h AS BIGINT) AS n_hit, x.o AS reparameterised
FROM best"""


_OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r < y.r
  WHERE x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL GROUP BY x.r, y.r
), links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM shared JOIN n p ON p.r = a JOIN n q ON q.r = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(x, y) AS (SELECT a, b FROM edges UNION SELECT x, b FROM reach JOIN edges ON y = a),
least_ AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       CAST(least(w.doc_id, coalesce(c, w.doc_id)) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN least_ ON x = w.doc_id"""

_OP10 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND response IS NOT NULL AND page_id IS DISTINCT FROM response
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM r"""


def _crc32(digits: str) -> str:
    """SQL of the CRC-32 of a text of ASCII characters, four bits a step."""

    def entry(x: int) -> int:
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        return x

    table = [entry(x) for x in range(16)]
    halves = f"flatten(list_transform(string_split({digits}, ''), lambda ch: [ord(ch) & 15, ord(ch) >> 4]))"
    start = f"list_concat([CAST(4294967295 AS BIGINT)], list_transform({halves}, lambda x: CAST(x AS BIGINT)))"
    step = f"list_reduce({start}, lambda a, x: xor(CAST({table} AS BIGINT[])[(xor(a, x) & 15) + 1], a >> 4))"
    return f"xor({step}, 4294967295)"


def _op11() -> str:
    k = prefix_trie
    return f"""
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % {k.GROUP} AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % {k.HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), s AS (
  SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS d FROM s),
p AS (
  SELECT conv_id, d, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY d) AS prefix FROM r
), path AS MATERIALIZED (
  SELECT conv_id AS c, d, len({_WORDS.format("text")}) AS words, min(conv_id) OVER (PARTITION BY d, prefix) AS node FROM p
  UNION ALL SELECT conv_id, 0, 0, min(conv_id) OVER () FROM c
), n AS (
  SELECT node, d, count(*) AS n_convs, any_value(words) AS words FROM path GROUP BY node, d
), up AS (
  SELECT n.*, path.node AS parent FROM n LEFT JOIN path ON path.c = n.node AND path.d = n.d - 1
), kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
own AS (
  SELECT up.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * words AS saved
  FROM up LEFT JOIN kids USING (node, d)
), total AS (
  SELECT path.node, path.d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM own JOIN path ON path.c = own.node AND path.d <= own.d GROUP BY path.node, path.d
), ends AS (
  SELECT node, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM path JOIN (SELECT c, max(d) AS d FROM path GROUP BY c) USING (c, d) GROUP BY node, d
)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(total.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN total USING (node, d) LEFT JOIN ends USING (node, d)"""


def _op12() -> str:
    k = part_codes

    def assigned(t: int) -> str:
        gap = "list_sum(list_transform(list_zip(p.c, e.c), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
        return f"""a{t} AS MATERIALIZED (
  SELECT r, part, min({{'d': d, 'e': entry}}) AS x
  FROM (SELECT p.r, p.part, e.entry, CAST({gap} AS BIGINT) AS d FROM p JOIN e{t} e USING (part))
  GROUP BY r, part
)"""

    def updated(t: int) -> str:
        return f"""e{t + 1} AS MATERIALIZED (
  SELECT e.part, e.entry, coalesce(m.c, e.c) AS c FROM e{t} e LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c
    FROM (SELECT p.part, a.x.e AS entry, i, sum(c[i]) AS s, count(*) AS n
          FROM a{t} a JOIN p USING (r, part), (SELECT unnest(generate_series(1, (SELECT w FROM width) // {k.PARTS})) AS i)
          GROUP BY 1, 2, 3)
    GROUP BY part, entry
  ) m USING (part, entry)
)"""

    rounds = ", ".join(x for t in range(k.ROUNDS) for x in (assigned(t), updated(t)))
    return f"""
WITH q AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor({k.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), width AS (
  SELECT len(v) AS w FROM q WHERE vec_id IS NOT NULL AND len(v) % {k.PARTS} = 0 ORDER BY vec_id, len(v) LIMIT 1
), kept AS MATERIALIZED (SELECT q.* FROM q, width WHERE len(v) = w),
p AS MATERIALIZED (
  SELECT r, part, v[part * (w // {k.PARTS}) + 1:(part + 1) * (w // {k.PARTS})] AS c
  FROM kept, width, (SELECT unnest(generate_series(0, {k.PARTS - 1})) AS part)
), seeds AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, arg_min(r, v) AS r
  FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {k.ENTRIES}
), e0 AS MATERIALIZED (SELECT part, entry, c FROM seeds JOIN p USING (r)),
{rounds}, {assigned(k.ROUNDS)},
coded AS (
  SELECT r, string_agg(printf('%02x', x.e), '' ORDER BY part) AS code, CAST(sum(x.d) AS BIGINT) AS error
  FROM a{k.ROUNDS} GROUP BY r
), digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM e{k.ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       h AS codebooks_sha256
FROM coded JOIN kept USING (r), digest"""


def _op13() -> str:
    k = scaled_sketch

    def reach(s: str) -> str:
        return f"CASE WHEN len({s}) < {k.LEAST} THEN 'g' ELSE greatest('{k.HIGHEST}', {s}[-1]) END"

    def near(a: str, b: str) -> str:
        top = f"least({reach(a)}, {reach(b)})"
        x, y = (f"list_filter({s}, lambda h: h <= {top})" for s in (a, b))
        both = f"len(list_intersect({x}, {y}))"
        return (
            f"CASE WHEN {a} = {b} THEN 1.0 ELSE"
            f" CAST({both} AS DOUBLE) / greatest(len({x}) + len({y}) - {both}, 1) END"
        )

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
ids AS (
  SELECT doc_id, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id
  FROM (SELECT DISTINCT doc_id FROM d WHERE doc_id IS NOT NULL)
), n AS (SELECT doc_id, arg_min(t, md5(t)) AS t FROM d WHERE doc_id IS NOT NULL GROUP BY doc_id),
e AS (
  SELECT d.doc_id, d.t, coalesce(n.t, '') AS nt,
         left(d.t, length(d.t) - length(d.t) // 4) || left(coalesce(n.t, ''), length(d.t) // 4) AS edited
  FROM d LEFT JOIN ids USING (doc_id) LEFT JOIN n ON n.doc_id = next_id
), w AS (
  SELECT t, {_WORDS.format("t")} AS w FROM (SELECT t FROM e UNION SELECT nt FROM e UNION SELECT edited FROM e)
), g AS (
  SELECT t, left(md5(array_to_string(w[i:i + {k.SHINGLE - 1}], ' ')), 16) AS h
  FROM (SELECT t, w, unnest(generate_series(1, greatest(1, len(w) - {k.SHINGLE - 1}))) AS i
        FROM w WHERE len(w) > 0)
), h AS (SELECT t, list_sort(list(DISTINCT h)) AS h FROM g GROUP BY t),
s AS (
  SELECT t, CASE WHEN h IS NULL THEN [] WHEN len(list_filter(h, lambda x: x <= '{k.HIGHEST}')) >= {k.LEAST}
                 THEN list_filter(h, lambda x: x <= '{k.HIGHEST}') ELSE h[1:{k.LEAST}] END AS s
  FROM w LEFT JOIN h USING (t)
), c AS (
  SELECT doc_id, e.t, edited, x.s AS a, y.s AS b, z.s AS c
  FROM e JOIN s x ON x.t = e.t JOIN s y ON y.t = edited JOIN s z ON z.t = nt
)
SELECT doc_id, length(t) AS n_chars, sha256(edited) AS edited_sha256,
       array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
       {near("a", "b")} AS near_edited, {near("a", "c")} AS near_next
FROM c"""


def statements() -> dict[str, str]:
    return {
        "op2_quality_rules": _op2(),
        "op3_line_dedup": _op3(),
        "op6_decontamination": _op6(),
        "op8_ngram_jaccard": _OP8,
        "op10_warc": _OP10,
        "op11_prefix_trie": _op11(),
        "op12_part_codes": _op12(),
        "op13_scaled_sketch": _op13(),
    }
