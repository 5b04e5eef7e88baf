"""DuckDB counterparts of the pN_ queries that SQL can express over whole tables."""

_KEY = "regexp_replace(lower(trim(replace(trim({0}), '\"', ''))), '[\\s_-]+', '_', 'g')"


def key(col: str) -> str:
    return _KEY.format(col)


ORACLES: dict[str, str] = {}

_LATEST = """WITH c AS (
  SELECT * FROM seed_conversations QUALIFY row_number() OVER (PARTITION BY coalesce(conversation_id, seed_id::VARCHAR) ORDER BY ingested_at DESC, seed_id DESC) = 1
), q AS (
  SELECT * FROM seed_questions QUALIFY row_number() OVER (PARTITION BY coalesce(qa_key, seed_id::VARCHAR) ORDER BY ingested_at DESC, seed_id DESC) = 1
), v AS (
  SELECT 'seed_conversations' AS tbl, 'advice_tier' AS field, {at} AS cat FROM c
  UNION ALL SELECT 'seed_conversations', 'product_scope', {ps} FROM c
  UNION ALL SELECT 'seed_conversations', 'label', {lb} FROM c
  UNION ALL SELECT 'seed_conversations', 'product_scope|advice_tier', {ps} || '|' || {at} FROM c
  UNION ALL SELECT 'seed_conversations', 'product_scope|label', {ps} || '|' || {lb} FROM c
  UNION ALL SELECT 'seed_questions', 'bloom_level', {bl} FROM q
), n AS (SELECT tbl, field, cat, count(*) AS available FROM v GROUP BY ALL)
""".format(at=key("advice_tier"), ps=key("product_scope"), lb=key("label"), bl=key("bloom_level"))

ORACLES["p3_found"] = _LATEST + f"""SELECT t.plan_id, t.category FROM sample_targets t
LEFT JOIN n ON n.tbl = t.tbl AND n.field = t.field AND n.cat = {key('t.category')}
WHERE coalesce(n.available, 0) < greatest(t.min_rows, floor(round(t.sample_rows * t.target_share, 6)))"""

ORACLES["p7_found"] = """SELECT c.pack_id, d.doc_id FROM documents d, containers c WHERE coalesce(strlen(d.text), 0) + 1 > c.capacity_tokens"""

ORACLES["p8_found"] = f"""WITH s AS (SELECT {key('source')} AS k, sum(coalesce(strlen(text), 0) + 1) AS tokens FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT t.mix_id, t.source FROM mix_targets t LEFT JOIN s ON s.k = {key('t.source')}
WHERE coalesce(s.tokens, 0) * t.max_repeats < t.total_tokens * t.target_weight"""
