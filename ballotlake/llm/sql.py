"""The SQL that a query of this subpackage must equal, where SQL can say it."""

from __future__ import annotations

_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(x, {i}, 1)) - 1) * {16 ** (8 - i)}" for i in range(1, 9))
_ENC = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEVELS = 9  # 8^9 leaves a lang


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_ENC.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, group: str) -> str:
    """From name_0 (group, i, hash): the nodes of each level, with siblings, and the subroot of each group in name_root."""
    parts = []
    for k in range(_LEVELS):
        parts.append(f"""{name}_s{k} AS (SELECT *, list_aggregate(l[1:i % 8], 'string_agg', '') lft, list_aggregate(l[i % 8 + 2:], 'string_agg', '') rgt
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) n, list(hash) OVER (PARTITION BY {group}, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) l FROM {name}_{k}))""")
        parts.append(f"{name}_{k + 1} AS (SELECT {group}, i // 8 i, sha256(string_agg(hash, '' ORDER BY i)) hash FROM {name}_s{k} WHERE n > 1 GROUP BY {group}, i // 8)")
    parts.append(f"{name}_root AS (" + " UNION ALL ".join(f"SELECT {group}, hash FROM {name}_s{k} WHERE n = 1" for k in range(_LEVELS)) + ")")
    return ",\n".join(parts)


def _climb(name: str, group: str, rows: str) -> str:
    """From rows (i0, group, tam, proof) to the same after all levels of the group."""
    parts, last = [], rows
    for k in range(_LEVELS):
        parts.append(f"""{rows}_{k} AS (SELECT r.* REPLACE (CASE WHEN s.n > 1 THEN r.proof || coalesce(s.lft, '') || coalesce(s.rgt, '') ELSE r.proof END AS proof,
    CASE WHEN s.n > 1 THEN sha256(coalesce(s.lft, '') || r.tam || coalesce(s.rgt, '')) ELSE r.tam END AS tam) FROM {last} r LEFT JOIN {name}_s{k} s ON s.{group} IS NOT DISTINCT FROM r.{group} AND s.i = r.i0 // {8**k})""")
        last = f"{rows}_{k}"
    return ",\n".join(parts)


_CAPS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: crc32 of the decimal doc_id, whose remainder by three is taken; DuckDB has none, so it is folded byte by byte over a table of its own.
_CRC = """tab AS (SELECT list(c ORDER BY b) t FROM (SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) c FROM range(256) r(b))),
crc AS (SELECT doc_id known, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) v FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), tab)"""

OP11 = f"""WITH {_CRC},
d AS (SELECT doc_id, lang, {_leaf("text")} leaf, CASE WHEN v % 3 = 0 THEN {_leaf(f"translate(text, '{_CAPS}', '{_CAPS.lower()}')")} END tampered FROM documents LEFT JOIN crc ON known = doc_id),
e AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 i0 FROM d),
t_0 AS (SELECT lang, i0 i, leaf hash FROM e),
{_tree("t", "lang")},
u_0 AS (SELECT 0 g, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 i, hash, lang FROM t_root),
{_tree("v", "g").replace("FROM v_0)", "FROM (SELECT g, i, hash FROM u_0))")},
r AS (SELECT e.*, coalesce(tampered, leaf) tam, '' proof FROM e),
{_climb("t", "lang", "r")},
w AS (SELECT r.* REPLACE (u_0.i AS i0), 0 g, u_0.hash subroot FROM r_{_LEVELS - 1} r JOIN u_0 ON u_0.lang IS NOT DISTINCT FROM r.lang),
{_climb("v", "g", "w")}
SELECT doc_id, leaf, subroot, v_root.hash root, sha256(proof) proof_sha256, tam folded_root, tam = v_root.hash verified FROM w_{_LEVELS - 1}, v_root"""

_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

OP12 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '{_UNIT}') u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) h FROM documents),
k AS (SELECT *, len(u)::BIGINT n, list_transform([substr(h, 1, 8), substr(h, 9, 8), substr(h, 17, 8), substr(h, 25, 8)], lambda x: ({_HEX})::BIGINT) r FROM d),
c AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) a, greatest(r[1] % (n + 1), r[2] % (n + 1)) b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END form FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:], '') suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) output_sha256, sha256(text) restored_sha256 FROM p"""

OP13 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id a, vec_id b FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT v.vec_id, coalesce(n, 0)::BIGINT n_links, c component_id, v.vec_id = c kept FROM v LEFT JOIN (SELECT a, count(*) n FROM l GROUP BY 1) m ON m.a = v.vec_id JOIN (SELECT a, min(b) c FROM reach GROUP BY 1) x ON x.a = v.vec_id"""
