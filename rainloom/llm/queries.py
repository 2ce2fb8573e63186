"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rainloom.llm import licenses, merkle, ogg, packing, pages, pieces, quality, sharding, shingles, substrings, tokens, toxicity, trie
from rainloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg_media": lambda spark, sf_dir: ogg.load(ogg.store(documents(spark, sf_dir))),
    "op2_host_consensus": lambda spark, sf_dir: pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")),
    "op3_super_kmers": lambda spark, sf_dir: substrings.remove(documents(spark, sf_dir)),
    "op4_best_fit_shards": lambda spark, sf_dir: sharding.shard(documents(spark, sf_dir)),
    "op5_piece_encoding": lambda spark, sf_dir: pieces.encode(documents(spark, sf_dir)),
    "op6_bin_slack_packing": lambda spark, sf_dir: packing.pack(documents(spark, sf_dir)),
    "op7_license_scan": lambda spark, sf_dir: licenses.scan(documents(spark, sf_dir)),
    "op8_token_counts": lambda spark, sf_dir: tokens.count_tokens(documents(spark, sf_dir)),
    "op9_quality_ledger": lambda spark, sf_dir: quality.judge(documents(spark, sf_dir)),
    "op10_circulant_minhash": lambda spark, sf_dir: shingles.near_duplicates(documents(spark, sf_dir)),
    "op11_merkle_manifest": lambda spark, sf_dir: merkle.manifest(documents(spark, sf_dir)),
    "op12_prefix_trie": lambda spark, sf_dir: trie.build(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
    "op13_nnpu_toxicity": lambda spark, sf_dir: toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The check sum of the decimal form of a number: its bytes, each followed by eight shifts.
_CRC32 = "xor(list_reduce(list_concat([4294967295], flatten([[ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1] for ch in string_split(CAST({0} AS VARCHAR), '')])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_field(n_chars if c == "n_chars" else c) for c in merkle.FIELDS) + ")"


def _siblings(nodes: str, tree: str) -> str:
    """What stands beside a node at each level, with its side; L and R carry the sibling, N says that there is none."""
    return f"""SELECT a.tree, a.pos, b.k, CASE WHEN s.h IS NULL THEN 'N' WHEN s.pos < b.pos THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM {nodes} AS a JOIN {nodes} AS b ON a.tree IS NOT DISTINCT FROM b.tree AND b.pos = a.pos >> b.k AND b.n > 1
  LEFT JOIN {nodes} AS s ON s.tree IS NOT DISTINCT FROM b.tree AND s.k = b.k AND s.pos = xor(b.pos, 1) WHERE a.k = 0"""


_RULES = " + ".join(f"CASE WHEN {rule} THEN {quality.BIT[name]} ELSE 0 END" for name, rule in quality.RULES.items())

ORACLE_SQL: dict[str, str] = {
    "op3_super_kmers": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20) AS u),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM p) AS o WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM g) AS c),
single AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS txt FROM single ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op9_quality_ledger": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
single AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM w),
three AS (SELECT doc_id, j, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM single WINDOW o AS (PARTITION BY doc_id ORDER BY j)),
twice AS (SELECT doc_id, j FROM (SELECT doc_id, j, count(*) OVER (PARTITION BY doc_id, word, b, c) AS n FROM three WHERE c IS NOT NULL) AS k WHERE n > 1),
again AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([j, j + 1, j + 2]) AS i FROM twice) AS k GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) AS k
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
      coalesce(again.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines, length(regexp_replace(array_to_string(ws, ''), '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_upper,
      length(regexp_replace(array_to_string(ws, ''), '[^\p{{L}}]', '', 'g')) AS n_letters,
      len(list_filter(ws, lambda x: regexp_matches(x, '(?:!!|\?\?|[#*$%&|<>]{{2,}})[.,;:]?$'))) AS n_marked
      FROM w LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, {_RULES} AS failed FROM m)
SELECT doc_id, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in quality.MEASURES)}, CAST(failed AS INTEGER) AS failed,
  failed & {quality.mask("base@1")} <> 0 AS base_failed, failed & {quality.mask(quality.CURRENT) | quality.mask("base@1")} = 0 AS kept FROM f""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT doc_id, lang, {_leaf()} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC32.format("doc_id")} % 7 = 0 THEN {_leaf("CAST(n_chars AS HUGEINT) + 1")} END AS tampered FROM documents) AS l),
nodes AS (SELECT lang AS tree, 0 AS k, pos, leaf AS h, n FROM ranked UNION ALL
    SELECT tree, k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, k, pos // 2),
roots AS (SELECT tree AS lang, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS tree, 0 AS k, pos, subroot AS h, n FROM roots UNION ALL
    SELECT tree, k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tops WHERE n > 1 GROUP BY tree, k, pos // 2),
low AS (SELECT tree, pos, list(step ORDER BY k) AS steps FROM ({_siblings("nodes", "lang")}) AS x GROUP BY ALL),
high AS (SELECT pos, list(step ORDER BY k) AS steps FROM ({_siblings("tops", "0")}) AS x GROUP BY ALL),
way AS (SELECT r.*, o.subroot, (SELECT h FROM tops WHERE n = 1) AS root, list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
    FROM ranked AS r JOIN roots AS o ON r.lang IS NOT DISTINCT FROM o.lang LEFT JOIN low ON low.tree IS NOT DISTINCT FROM r.lang AND low.pos = r.pos LEFT JOIN high ON high.pos = o.pos),
done AS (SELECT *, list_reduce(list_concat([coalesce(tampered, leaf)], steps), lambda h, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || h WHEN 'R' THEN h || x[2:] ELSE h END)) AS folded_root FROM way)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([x[2:] for x in steps], '')) AS proof_sha256, folded_root, folded_root = root AS verified, lang FROM done""",
    "op12_prefix_trie": f"""
WITH o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) - 1 AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) AS i),
c AS (SELECT conv_id, {_CRC32.format("conv_id")} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM o) AS u),
r AS (SELECT c.conv_id, p, role, text FROM c JOIN o ON o.conv_id = base AND p < h UNION ALL SELECT c.conv_id, p, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND p >= h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, sha256(strlen(role) || ':' || role || text) AS k, strlen(text) AS b FROM r),
q AS (SELECT conv_id, d, b, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM c),
lens AS (SELECT conv_id, max(d) AS d FROM q GROUP BY conv_id),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b FROM q GROUP BY node, d),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM q JOIN lens USING (conv_id, d) GROUP BY node),
pairs AS (SELECT DISTINCT x.node AS up, y.node AS down, y.d - x.d AS gap FROM q AS x JOIN q AS y ON x.conv_id = y.conv_id AND x.d <= y.d),
kids AS (SELECT up AS node, count(*) AS n_children FROM pairs WHERE gap = 1 GROUP BY up),
sums AS (SELECT up AS node, count(*) FILTER (kids.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.b) AS saved_tokens FROM pairs JOIN n ON n.node = down LEFT JOIN kids ON kids.node = down GROUP BY up)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node) LEFT JOIN (SELECT down, n.conv_id FROM pairs JOIN n ON n.node = up WHERE gap = 1) AS up ON up.down = n.node""",
}
