"""SQL of the entry model for the DuckDB side of the result checks."""

E = """
b AS (
  SELECT l.*, o.o_custkey, o.o_orderstatus, o.o_orderpriority, CAST(o.o_orderdate AS DATE) AS dt,
         p.p_brand, p.p_type, p.p_size,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS rn,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS pos,
         rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS pop,
         count(*) OVER (PARTITION BY l_orderkey) AS hc,
         l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS wp,
         (1 + round(l_discount * 100)) / sum(1 + round(l_discount * 100)) OVER (PARTITION BY l_orderkey) AS wpb,
         CAST(floor(l_extendedprice / 100) AS BIGINT) + 600 AS tenths
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
),
e AS (
  SELECT l_orderkey AS race_id, CAST(rn AS INT) AS horse_number, dt AS date, CAST(pos AS INT) AS finishing_position,
         l_partkey AS horse_id, l_suppkey AS jockey_id, l_suppkey % 17 AS trainer_id, o_custkey AS owner,
         p_brand AS sire, p_type AS broodmare_sire, l_returnflag AS venue, l_linestatus AS course_type,
         p_size * 60 AS distance, CAST(1 AS DOUBLE) + CAST(50 AS DOUBLE) / l_quantity AS odds,
         CAST(pop AS INT) AS popularity, CAST(hc AS INT) AS head_count,
         wp AS win_prob, least(CAST(1 AS DOUBLE), 3 * wp) AS place_prob,
         wpb AS win_prob_b, least(CAST(1 AS DOUBLE), 3 * wpb) AS place_prob_b,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'GI' WHEN '2-HIGH' THEN 'GII' WHEN '3-MEDIUM' THEN 'GIII'
              WHEN '4-NOT SPECIFIED' THEN 'L' END AS grade,
         CASE o_orderstatus WHEN 'F' THEN '良' WHEN 'O' THEN '稍重' WHEN 'P' THEN '重' END AS track_condition,
         CAST((rn - 1) % 8 + 1 AS INT) AS bracket_number,
         30 + 100 * l_discount AS last_3f, tenths / CAST(10 AS DOUBLE) AS finish_time_sec,
         l_linenumber AS first_corner_pos, CAST(l_orderkey % 6 AS DOUBLE) AS class_level,
         CAST(l_orderkey % 6 = 4 AS DOUBLE) AS is_handicap,
         50 + round(l_tax * 100) AS weight_carried, 400 + l_quantity AS horse_weight,
         CAST(l_quantity AS INT) % 21 - 10 AS horse_weight_diff,
         CASE WHEN o_custkey % 2 = 0 THEN '右' ELSE '左' END AS direction,
         CASE WHEN l_orderkey % 3 = 0 THEN '晴' ELSE '曇' END AS weather,
         CASE WHEN p_size % 2 = 0 THEN '牡' ELSE '牝' END AS sex, CAST(p_size % 10 + 2 AS DOUBLE) AS age,
         CAST(pos = 1 AS INT) AS is_win, CAST(pos <= 3 AS INT) AS is_placed, tenths
  FROM b
)"""

PAYOFFS = """
t3 AS (
  SELECT race_id,
         max(CASE WHEN finishing_position = 1 THEN horse_number END) AS h1,
         max(CASE WHEN finishing_position = 2 THEN horse_number END) AS h2,
         max(CASE WHEN finishing_position = 3 THEN horse_number END) AS h3,
         max(CASE WHEN finishing_position = 1 THEN odds END) AS o1,
         max(CASE WHEN finishing_position = 2 THEN odds END) AS o2,
         max(CASE WHEN finishing_position = 3 THEN odds END) AS o3
  FROM e GROUP BY race_id
),
pay0 AS (
  SELECT race_id, '単勝' AS bet_type, h1 || '' AS combination, 100 * o1 AS v FROM t3 WHERE h1 IS NOT NULL
  UNION ALL SELECT race_id, '複勝', h1 || '', 100 + 25 * (o1 - 1) FROM t3 WHERE h1 IS NOT NULL
  UNION ALL SELECT race_id, '複勝', h2 || '', 100 + 25 * (o2 - 1) FROM t3 WHERE h2 IS NOT NULL
  UNION ALL SELECT race_id, '複勝', h3 || '', 100 + 25 * (o3 - 1) FROM t3 WHERE h3 IS NOT NULL
  UNION ALL SELECT race_id, '馬連', h2 || '-' || h1, 50 * o1 * o2 FROM t3 WHERE h2 IS NOT NULL
  UNION ALL SELECT race_id, 'ワイド', h2 || '-' || h1, 20 * o1 * o2 FROM t3 WHERE h2 IS NOT NULL
  UNION ALL SELECT race_id, 'ワイド', h3 || '-' || h1, 20 * o1 * o3 FROM t3 WHERE h3 IS NOT NULL
  UNION ALL SELECT race_id, 'ワイド', h3 || '-' || h2, 20 * o2 * o3 FROM t3 WHERE h3 IS NOT NULL
  UNION ALL SELECT race_id, '三連複', h3 || '-' || h1 || '-' || h2, 30 * o1 * o2 * o3 FROM t3 WHERE h3 IS NOT NULL
),
pay AS (SELECT race_id, bet_type, combination, format('{:,}', CAST(floor(v) AS BIGINT)) AS payout FROM pay0)"""

POP_TIER = ("CASE WHEN {0} = 1 THEN '1番人気' WHEN {0} <= 3 THEN '2-3番人気' WHEN {0} <= 6 THEN '4-6番人気' "
            "ELSE '7番人気以下' END")


def with_e(*ctes: str) -> str:
    """``WITH`` clause of the entry model and further named queries."""
    return "WITH " + ",\n".join([E, *ctes])
