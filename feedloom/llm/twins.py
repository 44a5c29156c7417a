"""DuckDB SQL of the operators that SQL can express step by step."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS t
  FROM documents),
run AS (SELECT lang, list_filter(regexp_split_to_array(t, '[ \\t]+'), lambda x: x <> '') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM run GROUP BY lang),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM run),
gram AS (
  SELECT lang, w[i : i + k - 1] AS g, k FROM place, (VALUES (1), (2), (3)) x(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, g, any_value(k) AS k, count(*) AS a FROM gram GROUP BY lang, g),
often AS (SELECT * FROM f WHERE a >= 10),
way AS (
  SELECT lang, g, a, c.k AS size, x.k, g[1 : x.k] AS head, g[x.k + 1 :] AS tail FROM often c CROSS JOIN (VALUES (1), (2)) x(k) WHERE x.k < c.k),
cut AS (
  SELECT w.lang, w.g, w.a, w.k, l.a AS l, r.a AS r, CAST((1000000 * w.a::HUGEINT * w.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM way w JOIN often l ON l.lang = w.lang AND l.g = w.head JOIN often r ON r.lang = w.lang AND r.g = w.tail),
best AS (SELECT lang, g, a, unnest(min_by(struct_pack(l, r, score), struct_pack(score, k))) FROM cut GROUP BY lang, g, a),
inside AS (
  SELECT lang, s AS g, max(a) AS longest FROM (
    SELECT lang, g[1:2] AS s, a FROM often WHERE k = 3 UNION ALL SELECT lang, g[2:3], a FROM often WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g WHERE longest IS NULL OR 100 * longest < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

DEPTH = 8  # levels written out below: 16 777 216 leaves a language, far over the tables that SQL is run on


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_STEP = "xor(x >> 1, (x & 1) * 3988292384)"  # of the reflected CRC-32, bit by bit
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: {_STEP})))"""


def _tree(name: str, start: str, levels: int) -> list[str]:
    """``name``_0 .. ``name``_levels: nodes (g, i, node, n) of each level; a lone node stays as it is."""
    out = [f"{name}_0 AS (SELECT g, i, node, count(*) OVER (PARTITION BY g) AS n FROM ({start}))"]
    for k in range(levels):
        made = f"""SELECT g, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE any_value(node) END AS node
          FROM {name}_{k} GROUP BY g, i // 8"""
        out.append(f"{name}_{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({made}))")
    return out


def _folds(name: str, tree: str, start: str, levels: int) -> list[str]:
    """``name``_levels: rows (id, g, i, cur, sib) folded up ``tree``; ``sib`` holds the siblings met."""
    out = [f"{name}_0 AS ({start})"]
    for k in range(levels):
        out.append(f"""{name}_{k + 1} AS (
          SELECT d.id, d.g, d.i // 8 AS i,
            CASE WHEN any_value(s.n) > 1 THEN sha256(string_agg(CASE WHEN s.i = d.i THEN d.cur ELSE s.node END, '' ORDER BY s.i)) ELSE any_value(d.cur) END AS cur,
            any_value(d.sib) || coalesce(string_agg(s.node, '' ORDER BY s.i) FILTER (s.i <> d.i), '') AS sib
          FROM {name}_{k} d JOIN {tree}_{k} s ON s.g = d.g AND s.i // 8 = d.i // 8 GROUP BY d.id, d.g, d.i)""")
    return out


OP13_SQL = "WITH " + ",\n".join([
    f"""d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS g, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_leaf(LOWER.format("text"))} ELSE {_leaf("text")} END AS now
  FROM documents)""",
    "p AS (SELECT *, row_number() OVER (ORDER BY g, doc_id) AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
    *_tree("t", "SELECT g, i, leaf AS node FROM p", DEPTH),
    f"sub AS (SELECT g AS lang, row_number() OVER (ORDER BY g) - 1 AS i, node FROM t_{DEPTH})",
    *_tree("u", "SELECT '' AS g, i, node FROM sub", 2),
    *_folds("a", "t", "SELECT id, g, i, now AS cur, '' AS sib FROM p", DEPTH),
    *_folds("b", "u", f"SELECT a.id, '' AS g, sub.i, a.cur, a.sib FROM a_{DEPTH} a JOIN sub ON sub.lang = a.g", 2),
]) + """
SELECT p.doc_id, p.leaf, sub.node AS subroot, r.node AS root, sha256(b.sib) AS proof_sha256, b.cur AS folded_root, b.cur = r.node AS verified
FROM p JOIN sub ON sub.lang = p.g JOIN b_2 b ON b.id = p.id CROSS JOIN u_2 r"""
