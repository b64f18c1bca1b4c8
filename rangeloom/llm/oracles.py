"""DuckDB SQL for the document queries that SQL can say."""

from __future__ import annotations

from . import quality as q

#: Each window of 200 bytes as hexadecimal text, taken from pieces of 1000 window starts; stretches of repeated windows are joined where they touch.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT doc_id, o, substr(h, 2000 * o + 1, 2398) AS h FROM (SELECT doc_id, h, unnest(range(length(h) // 2000 + 1)) AS o FROM d) u),
 w AS MATERIALIZED (SELECT doc_id, 1000 * o + j AS i, md5_number(substr(h, 2 * j + 1, 400)) AS k FROM (SELECT *, unnest(range(length(h) // 2 - 199)) AS j FROM p) u),
 r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
 g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM r),
 s AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) x GROUP BY doc_id, run),
 b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS prev FROM s),
 a AS (SELECT doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) AS kept, max(hi) AS last, sum(hi - lo) AS cut, count(*) AS spans FROM b JOIN d USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(cut, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)"""

_P = range(q.P)
_PAIRS = [(i, j) for i in _P for j in range(i + 1)]


def _num(x: float) -> str:
    """A literal that is a double, not a decimal."""
    return f"{float(x)!r}e0"


def _distance(x: str = "", m: str = "") -> str:
    """Nested selects that add z_i, then d2, to a relation `FROM {}`."""
    sql = "{}"
    for i in _P:
        z = f"CAST({x}x{i} AS DOUBLE) / {_num(q.GRID)} - {m}m{i}"
        for j in range(i):
            z += f" - {m}l{i}{j} * z{j}"
        sql = f"(SELECT *, ({z}) / {m}l{i}{i} AS z{i} FROM {sql}) t{i}"
    return f"(SELECT *, {' + '.join(f'z{i} * z{i}' for i in _P)} AS d2 FROM {sql}) dist"


def _step(name: str, rows: str, est: str, by: list[str], prior: str = "") -> str:
    """One concentration step: CTEs that turn estimate `est` into estimate `name`."""
    keys = "".join(f"{k}, " for k in by)
    part = f"PARTITION BY {', '.join(by)} " if by else ""
    joined = f"(SELECT * FROM {rows} JOIN {est} USING ({', '.join(by)})) j" if by else f"(SELECT * FROM {rows}, {est}) j"
    sums = ["count(*) AS n", *[f"sum(x{i}) AS s{i}" for i in _P], *[f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in _PAIRS]]
    again = ["sum(n) AS n", *[f"sum(s{i}) AS s{i}" for i in _P], *[f"sum(s{i}{j}) AS s{i}{j}" for i, j in _PAIRS]]
    out = f"""{name}_b AS (SELECT {keys}CAST(least(floor(sqrt(d2) * 16e0), {q.BINS}) AS BIGINT) AS bin, {', '.join(sums)} FROM {_distance().format(joined)} GROUP BY {keys}bin),
 {name}_w AS (SELECT *, sum(n) OVER ({part}ORDER BY bin) - n AS before, sum(n) OVER ({part.rstrip()}) AS everything FROM {name}_b),
 {name}_s AS (SELECT {keys}{', '.join(again)} FROM {name}_w WHERE before < everything * {_num(q.SUPPORT)}{' GROUP BY ' + ', '.join(by) if by else ''}),
 {name}_m AS (SELECT *, {', '.join(f'CAST(s{i} AS DOUBLE) / CAST(n AS DOUBLE) / {_num(q.GRID)} AS m{i}' for i in _P)} FROM {name}_s)"""
    cov = []
    for i, j in _PAIRS:
        c = f"(CAST(s{i}{j} AS DOUBLE) / CAST(n AS DOUBLE) / {_num(q.GRID**2)} - m{i} * m{j}) * {_num(q.CONSISTENCY)}"
        cov.append(f"greatest({c}, 0e0) + {_num(q.SPREADS[i] ** 2)} AS c{i}{j}" if i == j else f"{c} AS c{i}{j}")
    sql = f"(SELECT *, {', '.join(cov)} FROM {name}_m) c"
    for i, j in _PAIRS:
        x = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        sql = f"(SELECT *, {f'sqrt({x})' if i == j else f'({x}) / l{j}{j}'} AS l{i}{j} FROM {sql}) f{i}{j}"
    means = [f"(m{i} * n + (SELECT m{i} FROM {prior}) * {_num(q.PRIOR)}) / (n + {_num(q.PRIOR)}) AS m{i}" if prior else f"m{i}" for i in _P]
    return f"{out},\n {name} AS (SELECT {keys}{', '.join(means)}, {', '.join(f'l{i}{j}' for i, j in _PAIRS)} FROM {sql})"


def _start(name: str, rows: str, by: list[str]) -> str:
    keys = "".join(f"{k}, " for k in by)
    medians = [f"list_sort(list(x{i}))[(count(*) + 1) // 2] / {_num(q.GRID)} AS m{i}" for i in _P]
    factor = [f"{_num(q.SPREADS[i] if i == j else 0)} AS l{i}{j}" for i, j in _PAIRS]
    return f"{name} AS (SELECT {keys}{', '.join(medians)}, {', '.join(factor)} FROM {rows}{' GROUP BY ' + ', '.join(by) if by else ''})"


def quality_sql() -> str:
    """The quality verdict, with the concentration steps written out."""
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    grid = lambda x: f"CAST(floor(({x}) * {_num(q.GRID)} + 0.5e0) AS BIGINT)"
    ratio = lambda a, b, k: f"ln(1e0 + {k}e0 * (CAST({a} AS DOUBLE) / greatest({b}, 1)))"
    vector = ["ln(CAST(greatest(word_chars, 1) AS DOUBLE) / greatest(n_words, 1))", ratio("n_symbols", "n_words", 20), ratio("n_dup_lines", "n_lines", 10), ratio("n_repeat_words", "n_words", 5)]
    keys = ["g_lang", "g_source"]
    parts = [
        "d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents)",
        f"""s0 AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {space}, '')) > 0) AS lines FROM d)""",
        "tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s0) u)",
        "twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) x WHERE n > 1)",
        "covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id)",
        f"""s1 AS (SELECT s0.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, length(translate(t, {space}, '')) AS word_chars,
  length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM s0 LEFT JOIN covered USING (doc_id))""",
        f"""s2 AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce('=' || lang, '') AS g_lang, coalesce('=' || source, '') AS g_source,
  {', '.join(f'{grid(x)} AS x{i}' for i, x in enumerate(vector))} FROM s1)""",
        f"r AS (SELECT g_lang, g_source, {', '.join(f'x{i}' for i in _P)} FROM s2 WHERE NOT base_failed)",
        _start("whole0", "r", []),
        *[_step(f"whole{k + 1}", "r", f"whole{k}", []) for k in range(q.STEPS)],
        _start("own0", "r", keys),
        *[_step(f"own{k + 1}", "r", f"own{k}", keys, f"whole{q.STEPS}" if k == q.STEPS - 1 else "") for k in range(q.STEPS)],
    ]
    final = _distance().format(f"(SELECT * FROM s2 LEFT JOIN own{q.STEPS} USING (g_lang, g_source)) j")
    return "WITH " + ",\n ".join(parts) + f"\n SELECT doc_id, {', '.join(q.RESULTS)}, NOT base_failed AND d2 <= {_num(q.CUTOFF)} AS kept FROM {final}"
