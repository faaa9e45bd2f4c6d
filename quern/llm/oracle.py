"""SQL for the queries that SQL can express; the others are tested against brute force, round trips or held-out labels."""

from __future__ import annotations

from quern.llm.common import EVAL_SPLITS
from quern.llm.consensus import SLOTS


def _canonical(x: str) -> str:
    return f"nullif(regexp_replace(lower(trim({x})), '[\\s\\-]+', '_', 'g'), '')"


def _class(x: str) -> str:
    low = f"regexp_replace(lower(trim({x})), '[\\s_\\-]+', ' ', 'g')"
    return f"CASE WHEN regexp_matches({low}, '^(ai|machine)( generated| written)?$') THEN 1 WHEN regexp_matches({low}, '^human( written)?$') THEN 0 END"


_SLOTS = f"unnest([{', '.join(f'annotator_{i}' for i in range(1, SLOTS + 1))}]) AS a"
_VOTES = f"""SELECT id, w, avg(g * 2 - 1) AS m FROM (SELECT id, trim(a.annotator_id) AS w, {_class("a.guess")} AS g FROM (SELECT id, {_SLOTS} FROM expert_articles))
  WHERE id IS NOT NULL AND w <> '' AND g IS NOT NULL GROUP BY id, w HAVING avg(g * 2 - 1) <> 0"""
_TARGETS = f"""WITH c AS (SELECT {_canonical("domain")} AS domain, label, lower(trim(dataset)) AS dataset, count(*) AS available FROM examples GROUP BY ALL), n AS (SELECT floor(count(*) * 0.1 + 1e-9)::BIGINT AS sample_size FROM examples),
  t AS (SELECT target_id, {_canonical("domain")} AS domain, label, lower(trim(dataset)) AS dataset, target_share, min_rows FROM sample_targets),
  r AS (SELECT t.*, sample_size, coalesce(available, 0) AS available, greatest(min_rows, ceil(target_share * sample_size - 1e-9)::BIGINT) AS wanted FROM t CROSS JOIN n LEFT JOIN c ON c.domain = t.domain AND c.label = t.label AND c.dataset = t.dataset)"""


def _sets(pool: str) -> str:
    """Distinct three-word sequences of the texts of ``pool`` (id, text) with at least 20 words."""
    return f"""w AS (SELECT id, regexp_extract_all(regexp_replace(lower(text), '<[^<>]*>', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({pool}) WHERE id IS NOT NULL AND text IS NOT NULL),
  s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
  n AS (SELECT id, count(*) AS n FROM s GROUP BY id)"""


_EVALS = ", ".join(f"'{s}'" for s in EVAL_SPLITS)

ORACLE: dict[str, str] = {
    "p1_agreement": f"""WITH v AS ({_VOTES}), u AS (SELECT id, count(*) FILTER (m > 0)::DOUBLE AS a, count(*)::DOUBLE AS m FROM v GROUP BY id HAVING count(*) >= 2),
      s AS (SELECT sum(2 * a * (m - a) / (m - 1)) AS o, sum(a) AS a, sum(m) AS m, count(*) AS units FROM u)
      SELECT CASE WHEN a * (m - a) > 0 THEN round(1 - o / (2 * a * (m - a) / (m - 1)), 9) END AS alpha, coalesce(m, 0)::BIGINT AS pairable_votes, units FROM s""",
    "p4_found": f"""WITH e AS (SELECT id, text, lower(trim(split)) AS split FROM examples), {_sets("SELECT id, text FROM e WHERE split = 'train' OR split IN (" + _EVALS + ")")},
      p AS (SELECT x.id AS e, y.id AS t, count(*) AS k FROM s x JOIN e ex ON ex.id = x.id AND ex.split IN ({_EVALS}) JOIN s y ON y.g = x.g JOIN e ey ON ey.id = y.id AND ey.split = 'train' GROUP BY ALL)
      SELECT least(e, t) AS id_a, greatest(e, t) AS id_b FROM p JOIN n ON n.id = p.e WHERE k / n.n >= 0.6 - 1e-12""",
    "p6_targets": f"{_TARGETS} SELECT target_id, domain, label, dataset, target_share, min_rows, sample_size, available, wanted, least(available, wanted) AS drawn_aim, available >= wanted AS feasible FROM r",
    "p6_found": f"{_TARGETS} SELECT target_id FROM r WHERE available < wanted",
    "p7_found": f"""WITH {_sets("SELECT id, text FROM examples UNION ALL SELECT source_id, source_text FROM pair_docs")},
      p AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id < y.id GROUP BY ALL)
      SELECT id_a, id_b FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE k / (a.n + b.n - k) >= 0.5""",
}
