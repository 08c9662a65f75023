"""DuckDB SQL for the proxy tables and registered queries (the independent oracle).

Each proxy is written once here as a CTE over the driver tables; query SQL is
``WITH <needed proxies> <select>``. Dialect bridges: ``regexp_matches`` for
``rlike``, ``date_diff('day', b, a)`` for ``datediff(a, b)``, ``list_*`` for
array functions, ``quantile_cont`` for ``percentile``.
"""

from __future__ import annotations

PROXY_SQL: dict[str, str] = {
    "p_accounts": """
        SELECT p_partkey AS id, CAST(p_size % 25 AS INTEGER) AS grp, p_retailprice AS grp_val,
               p_name AS username, p_type AS description, p_brand AS location,
               CAST(p_size * 100 AS BIGINT) AS followers_count, CAST(p_size AS BIGINT) AS following_count,
               p_type = 'PROMO' AS verified
        FROM part""",
    "p_influencers": """
        SELECT id AS uid, grp FROM (
          SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY grp_val DESC, id) AS rn
          FROM p_accounts) WHERE rn <= 3500""",
    "p_tweets": """
        SELECT e.event_id AS id_str, e.user_id AS user_id, e.ts AS ts,
               CASE WHEN d.n_chars <= 280 THEN d.text END AS short_text, d.text AS extended_text,
               CASE WHEN e.event_type IN ('click', 'purchase') THEN 1 END AS retweeted_id,
               CASE WHEN e.event_type = 'error' THEN 1 END AS quoted_id,
               CASE WHEN e.event_type = 'signup' OR e.value > 400 THEN 1 END AS reply_user
        FROM events e JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)""",
    "p_follows": """
        SELECT DISTINCT o_custkey AS source, l_partkey AS target
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "p_labels": """
        SELECT n_nationkey AS k,
               CASE WHEN n_nationkey % 7 = 3 THEN 'Non-US ' || n_name ELSE n_name END AS Label,
               CASE WHEN n_nationkey % 9 = 0 THEN 'No Clear Pattern' ELSE r_name END AS narrow_label,
               CASE r_name WHEN 'AFRICA' THEN 'Political' WHEN 'AMERICA' THEN '(Local) News'
                           WHEN 'ASIA' THEN 'Sports' WHEN 'EUROPE' THEN 'Entertain/Influencer'
                           ELSE 'Other' END AS meta,
               CASE r_name WHEN 'AFRICA' THEN 'Political' WHEN 'AMERICA' THEN 'Local'
                           WHEN 'ASIA' THEN 'Sports' WHEN 'EUROPE' THEN 'Celeb/Influencer'
                           ELSE 'News' END AS Metalabel1
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "p_panel": """
        SELECT c_custkey AS twProfileID,
               CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 18 + c_custkey % 70 END AS INTEGER) AS voterbase_age,
               CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS voterbase_gender,
               CASE c_custkey % 5 WHEN 0 THEN 'Caucasian' WHEN 1 THEN 'African-American' WHEN 2 THEN 'Uncoded'
                                  WHEN 3 THEN 'Hispanic' ELSE 'Other' END AS voterbase_race,
               CAST((c_custkey * 37) % 100 AS DOUBLE) AS tsmart_partisan_score,
               CASE WHEN (c_custkey * 37) % 100 < 35 THEN 'Republican'
                    WHEN (c_custkey * 37) % 100 < 65 THEN 'Independent' ELSE 'Democrat' END AS party
        FROM customer""",
    "p_tweet_counts_wide": """
        SELECT strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS date, a.grp AS grp, l_partkey AS userid,
               l_linestatus = 'O' AS is_rt, count(*) AS total,
               count(*) FILTER (WHERE l_returnflag = 'R') AS pol,
               count(*) FILTER (WHERE l_returnflag = 'A') AS blm
        FROM lineitem JOIN p_accounts a ON a.id = l_partkey
        GROUP BY 1, 2, 3, 4""",
    "p_tweet_counts": """
        SELECT * FROM (
          SELECT date, grp, userid, is_rt, 'total' AS regex_type, total AS count FROM p_tweet_counts_wide
          UNION ALL SELECT date, grp, userid, is_rt, 'pol', pol FROM p_tweet_counts_wide
          UNION ALL SELECT date, grp, userid, is_rt, 'blm', blm FROM p_tweet_counts_wide) WHERE count > 0""",
    "p_infl": """
        SELECT a.*, coalesce(c.pol, 0) AS pol, coalesce(c.blm, 0) AS blm, coalesce(c.total, 0) AS total,
               l.Label, l.narrow_label, l.meta
        FROM p_accounts a
        LEFT JOIN (SELECT userid,
                          sum(count) FILTER (WHERE regex_type = 'pol') AS pol,
                          sum(count) FILTER (WHERE regex_type = 'blm') AS blm,
                          sum(count) FILTER (WHERE regex_type = 'total') AS total
                   FROM p_tweet_counts GROUP BY userid) c ON c.userid = a.id
        JOIN p_labels l ON l.k = a.grp""",
    "p_net": """
        SELECT f.source, i.grp, count(*) AS count
        FROM p_follows f JOIN p_influencers i ON i.uid = f.target GROUP BY 1, 2""",
    "p_shares": """
        SELECT n.source, n.grp, n.count, n.count / sum(n.count) OVER (PARTITION BY n.source) AS prop
        FROM p_net n WHERE n.grp IN (SELECT k FROM p_labels)""",
    "p_clust_stats": """
        SELECT s.grp,
          sum(prop) AS n,
          sum(CASE WHEN voterbase_age IS NOT NULL AND voterbase_age < 75 THEN voterbase_age * prop END)
            / sum(CASE WHEN voterbase_age IS NOT NULL AND voterbase_age < 75 THEN prop END) AS age,
          sum(CASE WHEN voterbase_gender = 'Male' THEN prop ELSE 0 END) / sum(CASE WHEN voterbase_gender IS NOT NULL THEN prop END) AS male,
          sum(CASE WHEN party = 'Democrat' THEN prop ELSE 0 END) / sum(prop) AS dem,
          sum(CASE WHEN party = 'Republican' THEN prop ELSE 0 END) / sum(prop) AS rep,
          sum(CASE WHEN party = 'Independent' THEN prop ELSE 0 END) / sum(prop) AS indep,
          sum(CASE WHEN voterbase_race NOT IN ('Uncoded', 'Other') AND voterbase_race = 'Caucasian' THEN prop ELSE 0 END)
            / sum(CASE WHEN voterbase_race NOT IN ('Uncoded', 'Other') THEN prop END) AS white,
          sum(CASE WHEN voterbase_race NOT IN ('Uncoded', 'Other') AND voterbase_race = 'African-American' THEN prop ELSE 0 END)
            / sum(CASE WHEN voterbase_race NOT IN ('Uncoded', 'Other') THEN prop END) AS black,
          sum(CASE WHEN voterbase_race NOT IN ('Uncoded', 'Other') AND voterbase_race = 'Caucasian' AND party = 'Democrat' THEN prop ELSE 0 END)
            / sum(CASE WHEN voterbase_race NOT IN ('Uncoded', 'Other') THEN prop END) AS white_lib,
          ln(sum(prop)) AS log_n
        FROM p_shares s JOIN p_panel p ON p.twProfileID = s.source
        GROUP BY s.grp""",
    "p_infl_audience": """
        SELECT f.target AS influencer_id, avg(voterbase_age) AS age_avg, count(*) AS source_id_count,
               stddev_samp(voterbase_age) AS age_std, CAST(median(voterbase_age) AS DOUBLE) AS age_median,
               avg(CASE WHEN voterbase_race = 'Asian' THEN 1.0 ELSE 0.0 END) AS "race_Asian",
               avg(CASE WHEN voterbase_race = 'African-American' THEN 1.0 ELSE 0.0 END) AS "race_African-American",
               avg(CASE WHEN voterbase_race IS NULL THEN 1.0 ELSE 0.0 END) AS "race_None",
               avg(CASE WHEN voterbase_race = 'Uncoded' THEN 1.0 ELSE 0.0 END) AS "race_Unknown",
               avg(CASE WHEN voterbase_race = 'Caucasian' THEN 1.0 ELSE 0.0 END) AS "race_Caucasian",
               avg(CASE WHEN voterbase_race = 'Hispanic' THEN 1.0 ELSE 0.0 END) AS "race_Hispanic",
               avg(CASE WHEN voterbase_race = 'Other' THEN 1.0 ELSE 0.0 END) AS "race_Other",
               avg(CASE WHEN party = 'Independent' THEN 1.0 ELSE 0.0 END) AS "party_Independent",
               avg(CASE WHEN party = 'Democrat' THEN 1.0 ELSE 0.0 END) AS "party_Democrat",
               avg(CASE WHEN party = 'Republican' THEN 1.0 ELSE 0.0 END) AS "party_Republican",
               avg(CASE WHEN voterbase_gender = 'Male' THEN 1.0 ELSE 0.0 END) AS "gender_Male",
               avg(CASE WHEN voterbase_gender = 'Female' THEN 1.0 ELSE 0.0 END) AS "gender_Female",
               avg(CASE WHEN voterbase_gender IS NULL THEN 1.0 ELSE 0.0 END) AS "gender_None",
               avg(CASE WHEN voterbase_gender IS NOT NULL AND voterbase_gender NOT IN ('Male', 'Female') THEN 1.0 ELSE 0.0 END) AS "gender_Unknown"
        FROM p_follows f JOIN p_panel p ON p.twProfileID = f.source
        GROUP BY f.target""",
    "p_centrality": "SELECT p_partkey AS id, p_retailprice / 1000.0 AS approx_rw_centr FROM part",
}

# Dependencies between proxies (each entry lists the proxies it reads).
PROXY_DEPS: dict[str, tuple[str, ...]] = {
    "p_influencers": ("p_accounts",),
    "p_tweet_counts_wide": ("p_accounts",),
    "p_tweet_counts": ("p_tweet_counts_wide",),
    "p_infl": ("p_accounts", "p_tweet_counts", "p_labels"),
    "p_net": ("p_follows", "p_influencers"),
    "p_shares": ("p_net", "p_labels"),
    "p_clust_stats": ("p_shares", "p_panel"),
    "p_infl_audience": ("p_follows", "p_panel"),
}


def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in PROXY_DEPS.get(n, ()):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_proxies(body: str, *names: str) -> str:
    """``WITH`` clause holding the named proxies (and their dependencies) + body."""
    ctes = ",\n".join(f"{n} AS ({PROXY_SQL[n]})" for n in _order(names))
    return f"WITH {ctes}\n{body}"
