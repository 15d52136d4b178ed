"""Common table expressions of the DuckDB statements in ``queries``: the sketch, the index and the chains."""

from __future__ import annotations

from strandloom.functions.sequence import HASH_ROUNDS

_HALF = 4**7


def _hash_steps(source: str, bits: int = 30) -> str:
    """A chain of subqueries that applies the hash rounds to column x of ``source``."""
    mask = (1 << bits) - 1
    for kind, by in HASH_ROUNDS:
        if kind == "not_add":
            step = f"((-x - 1) + (x << {by})) & {mask}"
        elif kind == "xor":
            step = f"xor(x, x >> {by})"
        elif kind == "add":
            step = f"(x + (x << {by})) & {mask}"
        else:
            step = f"(x + (x << {by[0]}) + (x << {by[1]})) & {mask}"
        source = f"(SELECT * EXCLUDE (x), {step} AS x FROM {source})"
    return source


def kmers(name: str, table: str, key: str, compressed: bool = False) -> str:
    """CTEs ``{name}_b`` (rid, i, b) and ``{name}_k`` (rid, pos, f, r) with the 15-mers in the text alphabet.

    ``compressed`` counts repeats of a base once: ``{name}_b`` then has the place of the last of them too.
    """
    w = "OVER (PARTITION BY rid ORDER BY i)"
    bases = f"""SELECT rid, i, CAST(ascii(c) % 4 AS BIGINT) AS b FROM (
  SELECT rid, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i FROM {name}_c)"""
    if compressed:
        bases = f"""SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY place) - 1 AS i, b, place FROM (
  SELECT rid, i AS place, b, lead(b) {w} AS following FROM ({bases})) WHERE following IS NULL OR following <> b"""
    lag = lambda c, n: f"lag({c}, {n}) {w}"
    return f"""
{name}_c AS (SELECT {key} AS rid, string_split(text, '') AS cs FROM {table} WHERE length(text) > 0),
{name}_b AS ({bases}),
{name}_2 AS (SELECT rid, i, {lag('b', 1)} * 4 + b AS f, (3 - b) * 4 + (3 - {lag('b', 1)}) AS r FROM {name}_b),
{name}_4 AS (SELECT rid, i, {lag('f', 2)} * 16 + f AS f, r * 16 + {lag('r', 2)} AS r FROM {name}_2),
{name}_8 AS (SELECT rid, i, {lag('f', 4)} * 256 + f AS f, r * 256 + {lag('r', 4)} AS r FROM {name}_4),
{name}_k AS (SELECT rid, i AS pos, f, r FROM (
  SELECT rid, i, {lag('f', 7)} * {_HALF} + f % {_HALF} AS f, r * {_HALF} + {lag('r', 7)} % {_HALF} AS r FROM {name}_8) WHERE i >= 14)"""


def sketch(name: str, table: str, key: str, w: int = 10, compressed: bool = False) -> str:
    """The CTEs of ``kmers`` and ``{name}`` (rid, pos, strand, hash, span), the minimizers of a table's texts."""
    place = "rid, CAST(pos AS INTEGER) AS pos, strand, hash, 15 AS span"
    whole = f"{name}_f"
    if compressed:
        place = "rid, CAST(place AS INTEGER) AS pos, strand, hash, CAST(place - before AS INTEGER) AS span"
        whole = f"(SELECT f.*, p.place, p.before FROM {name}_f f JOIN (SELECT rid, i, place, coalesce(lag(place, 15) OVER (PARTITION BY rid ORDER BY i), -1) AS before FROM {name}_b) p ON p.rid = f.rid AND p.i = f.pos)"
    hashed = _hash_steps(f"(SELECT rid, pos, CASE WHEN r < f THEN 1 ELSE 0 END AS strand, least(f, r) AS x FROM {name}_k)")
    return f"""{kmers(name, table, key, compressed)},
{name}_h AS (SELECT rid, pos, strand, x AS hash FROM {hashed}),
{name}_f AS (SELECT *, CASE WHEN row_number() OVER o >= {w} OR row_number() OVER o = count(*) OVER (PARTITION BY rid)
  THEN min(hash) OVER (o ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) END AS low FROM {name}_h WINDOW o AS (PARTITION BY rid ORDER BY pos)),
{name} AS (SELECT {place} FROM (
  SELECT *, max(low) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS reach FROM {whole}) WHERE reach = hash)"""


def threshold(name: str) -> str:
    """CTEs ``{name}_occ`` (hash, occ) and ``{name}_mid`` (mid_occ)."""
    return f"""
{name}_occ AS (SELECT hash, count(*) AS occ FROM {name} GROUP BY hash),
{name}_mid AS (SELECT CAST(least(greatest(coalesce(min(occ) + 1, 10), 10), 1000000) AS BIGINT) AS mid_occ FROM (
  SELECT occ, row_number() OVER (ORDER BY occ) AS n_th, count(*) OVER () AS n FROM {name}_occ) WHERE n_th > floor((1 - 2e-4) * n))"""


def both() -> str:
    """Sketches of benchmark (b) and documents (d), and the documents' threshold."""
    return f"{sketch('b', 'benchmark', 'item_id')},{sketch('d', 'documents', 'doc_id')},{threshold('d')}"


def anchors(rare: bool = True) -> str:
    """``both`` and ``a`` (read_id, rid, rev, rpos, qpos, span), of rare minimizers or of all."""
    kept = "JOIN d_occ o ON o.hash = q.hash, d_mid WHERE o.occ <= d_mid.mid_occ" if rare else ""
    return f"""{both()},
len AS (SELECT item_id AS rid, CAST(coalesce(length(text), 0) AS INTEGER) AS len FROM benchmark),
a AS (SELECT q.rid AS read_id, r.rid AS rid, q.strand <> r.strand AS rev, r.pos AS rpos,
  CAST(CASE WHEN q.strand <> r.strand THEN len.len - (q.pos + 1 - 15) - 1 ELSE q.pos END AS INTEGER) AS qpos, 15 AS span
  FROM b q JOIN len ON len.rid = q.rid JOIN d r ON r.hash = q.hash {kept})"""


def chain(a: str, out: str, max_gap: int = 5000) -> str:
    """CTE ``out``: islands of the anchors ``a``."""
    return f"""
{out}_s AS (SELECT *, rpos - qpos AS diag, rpos - lag(rpos) OVER (PARTITION BY read_id, rid, rev, rpos - qpos ORDER BY rpos) AS step FROM {a}),
{out}_o AS (SELECT *, sum(CASE WHEN step <= {max_gap} THEN 0 ELSE 1 END) OVER (PARTITION BY read_id, rid, rev, diag ORDER BY rpos) AS island FROM {out}_s),
{out} AS (SELECT read_id, rid, rev, diag, island, CAST(count(*) AS INTEGER) AS cnt,
  CAST(sum(CASE WHEN step <= {max_gap} THEN least(15, step) ELSE 15 END) AS INTEGER) AS score,
  CAST(sum(CASE WHEN step <= {max_gap} THEN step ELSE 15 END) AS INTEGER) AS blen,
  min(rpos) AS first_r, max(rpos) AS last_r, min(qpos) AS first_q, max(qpos) AS last_q FROM {out}_o GROUP BY 1, 2, 3, 4, 5)"""


def regions(chains: str, lengths: str, out: str, min_score: int = 40) -> str:
    """CTE ``out``: regions of the chains of at least 3 anchors."""
    return f"""
{out} AS (SELECT read_id, c.rid, rev,
  CAST(CASE WHEN rev THEN l.len - (last_q + 1) ELSE first_q - 14 END AS INTEGER) AS qs,
  CAST(CASE WHEN rev THEN l.len - (first_q - 14) ELSE last_q + 1 END AS INTEGER) AS qe,
  CAST(greatest(0, first_r - 14) AS INTEGER) AS rs, CAST(last_r + 1 AS INTEGER) AS re, score, cnt, score AS mlen, blen
  FROM {chains} c JOIN {lengths} l ON l.rid = c.read_id WHERE cnt >= 3 AND score >= {min_score})"""


def mapped() -> str:
    """``anchors`` and ``m``, the regions of benchmark texts on documents."""
    return f"{anchors()},{chain('a', 'c')},{regions('c', 'len', 'm')}"


def best() -> str:
    """``mapped`` and ``best``: each text's best hits by place."""
    return f"""{mapped()},
top AS (SELECT read_id, max(score) AS top_score FROM m GROUP BY 1),
best AS (SELECT * FROM (SELECT m.*, CAST(row_number() OVER (PARTITION BY m.read_id ORDER BY score DESC, cnt DESC, rid, rev, rs, qs) AS INTEGER) AS place
  FROM m JOIN top ON top.read_id = m.read_id WHERE score >= top_score * 0.8 OR score + 30 >= top_score) WHERE place <= 6)"""


def rivals() -> str:
    """CTE ``v``, to follow ``mapped``: the regions with sub and sub_n, their best rival's score and the near ones' number."""
    key = ("read_id", "rid", "rev", "qs", "qe", "rs")
    same = " AND ".join(f"n.{k} = m.{k}" for k in key)
    return f"""
n AS (SELECT {', '.join(f'x.{k}' for k in key)}, max(y.score) AS sub, CAST(sum(CASE WHEN x.score - y.score <= 11 THEN 1 ELSE 0 END) AS INTEGER) AS sub_n
FROM m x JOIN m y ON y.read_id = x.read_id AND (x.rid, x.rev, x.qs, x.qe, x.rs) <> (y.rid, y.rev, y.qs, y.qe, y.rs) AND y.score <= x.score
  AND (least(x.qe, y.qe) - greatest(x.qs, y.qs)) * 2 >= least(x.qe - x.qs, y.qe - y.qs) GROUP BY ALL),
v AS (SELECT m.*, coalesce(n.sub, 0) AS sub, coalesce(n.sub_n, 0) AS sub_n FROM m LEFT JOIN n ON {same})"""


def mapq_short() -> str:
    """Expression of the short-read mapping quality of a row of ``v``."""
    length = "CAST(greatest(qe - qs, re - rs) AS DOUBLE)"
    rival = "CASE WHEN sub > 0 THEN sub ELSE 19 END"
    identity = f"(1 - ({length} * 1 - score) / 5 / {length})"
    by_length = f"(CASE WHEN {length} < 50 THEN 1.0 ELSE ln(CAST(50 AS DOUBLE)) / ln({length}) END)"
    weight = f"({by_length} * {identity} * {identity})"
    raw = f"trunc(CAST(6.02 AS DOUBLE) * (score - {rival}) / 1 * {weight} * {weight} + CAST(0.499 AS DOUBLE))"
    less = f"({raw} - CASE WHEN sub_n > 0 THEN trunc(CAST(4.343 AS DOUBLE) * ln(sub_n + CAST(1 AS DOUBLE)) + CAST(0.499 AS DOUBLE)) ELSE 0 END)"
    return f"CAST(CASE WHEN {rival} >= score THEN 0 ELSE greatest(0, least(60, {less})) END AS INTEGER)"


def exact(p: str = "") -> str:
    """CTE ``{p}x``: maximal exact matches of benchmark texts and documents (read_id, rid, rev, qbeg, qend, rbeg)."""
    return f"""{sketch(p + 'b', 'benchmark', 'item_id', 1)},{sketch(p + 'd', 'documents', 'doc_id', 1)},
{p}l AS (SELECT item_id AS rid, length(text) AS len FROM benchmark),
{p}a AS (SELECT x.rid AS read_id, y.rid AS rid, x.strand <> y.strand AS rev, y.pos AS rpos, CASE WHEN x.strand <> y.strand THEN l.len - (x.pos - 14) - 1 ELSE x.pos END AS qpos FROM {p}b x JOIN {p}l l ON l.rid = x.rid JOIN {p}d y ON y.hash = x.hash),
{p}s AS (SELECT *, rpos - qpos AS diag, CASE WHEN rpos - lag(rpos) OVER (PARTITION BY read_id, rid, rev, rpos - qpos ORDER BY rpos) = 1 THEN 0 ELSE 1 END AS cut FROM {p}a),
{p}o AS (SELECT *, sum(cut) OVER (PARTITION BY read_id, rid, rev, diag ORDER BY rpos) AS part FROM {p}s),
{p}x AS (SELECT read_id, rid, rev, CAST(min(qpos) - 14 AS INTEGER) AS qbeg, CAST(max(qpos) + 1 AS INTEGER) AS qend, CAST(min(rpos) - 14 AS INTEGER) AS rbeg FROM {p}o GROUP BY read_id, rid, rev, diag, part)"""
