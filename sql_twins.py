"""DuckDB SQL twins of the registered queries, over the same test tables.

Each statement is built from shared CTEs: the test tables seen as event tables,
then user sets and label relations.  Sets are formed with joins here, while the
package forms them with one aggregation, so the two check each other.
"""

from __future__ import annotations

# Countries of the market-scoped runs.
MARKETS = (
    "NATION_3",
    "NATION_4",
    "NATION_10",
    "NATION_11",
    "NATION_16",
    "NATION_17",
    "NATION_19",
    "NATION_20",
)

IN_MARKETS = f"country IN ({', '.join(repr(m) for m in MARKETS)})"
SCOPE = "platform = 'IOS' AND version = '1.0.5'"
FIRST_OPEN = "event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-04'"
REGARD = "event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-30'"
WHOLE = "event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'"
U = "user_pseudo_id"

_BASE = f"""
log AS (
  SELECT CAST(user_id AS VARCHAR) AS {U}, epoch_us(ts) AS event_timestamp,
         CAST(ts AS DATE) AS event_date, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 + 1 AS level,
         n_name AS country, c_mktsegment AS mobile_name,
         CASE WHEN user_id % 4 = 0 THEN 'ANDROID' ELSE 'IOS' END AS platform,
         CASE WHEN user_id % 5 = 0 THEN '1.0.4' ELSE '1.0.5' END AS version
  FROM events
  LEFT JOIN customer ON c_custkey = user_id
  LEFT JOIN nation ON n_nationkey = c_nationkey
),
user_engagement AS (SELECT * FROM log),
session_start AS (SELECT * FROM log WHERE event_type = 'view'),
start_level AS (SELECT * FROM log WHERE event_type = 'view'),
win_level AS (SELECT * FROM log WHERE event_type = 'click'),
lose_level AS (SELECT * FROM log WHERE event_type = 'error'),
first_open AS (
  SELECT * FROM log WHERE event_type = 'signup'
  QUALIFY row_number() OVER (PARTITION BY {U} ORDER BY event_timestamp) = 1
),
in_app_purchase AS (
  SELECT *, value AS event_value_in_usd FROM log WHERE event_type = 'purchase' AND value >= 200
),
ads_reward_complete AS (
  SELECT *, 'p' || (k % 4) AS placement FROM log WHERE event_type = 'error' AND value >= 150
),
booster_use AS (
  SELECT *, 'b' || (k % 3) AS booster_type FROM log WHERE event_type = 'signup' AND value < 20
),
af_rewarded AS (SELECT * FROM log WHERE event_type = 'click' AND value >= 100),
cohort AS (SELECT DISTINCT {U} FROM first_open WHERE {SCOPE} AND {FIRST_OPEN}),
market_cohort AS (
  SELECT DISTINCT {U} FROM first_open WHERE {SCOPE} AND {IN_MARKETS} AND {FIRST_OPEN}
),
ever_paid AS (SELECT DISTINCT {U} FROM in_app_purchase WHERE {SCOPE}),
paid AS (SELECT DISTINCT {U} FROM in_app_purchase WHERE {SCOPE} AND {WHOLE}),
market_paid AS (
  SELECT DISTINCT {U} FROM in_app_purchase WHERE {SCOPE} AND {IN_MARKETS} AND {WHOLE}
),
ever_watched AS (SELECT DISTINCT {U} FROM ads_reward_complete WHERE {SCOPE}),
watched AS (SELECT DISTINCT {U} FROM ads_reward_complete WHERE {SCOPE} AND {WHOLE}),
engaged AS (SELECT DISTINCT {U} FROM user_engagement WHERE {SCOPE}),
engaged_whole AS (SELECT DISTINCT {U} FROM user_engagement WHERE {SCOPE} AND {WHOLE}),
market_engaged AS (
  SELECT DISTINCT {U} FROM user_engagement WHERE {SCOPE} AND {IN_MARKETS} AND {WHOLE}
)
"""


# The same for the harder log of the binding.
_HARD_BASE = (
    _BASE.replace(
        f"CAST(user_id AS VARCHAR) AS {U}, epoch_us(ts) AS event_timestamp",
        "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '1' "
        f"ELSE CAST(user_id AS VARCHAR) END AS {U}, "
        "epoch_us(ts) // 3600000000 * 3600000000 AS event_timestamp",
    )
    .replace("% 10 + 1 AS level", "% 100 + 1 AS level")
    .replace(
        f"""
  QUALIFY row_number() OVER (PARTITION BY {U} ORDER BY event_timestamp) = 1""",
        "",
    )
    .replace(f"SELECT DISTINCT {U} FROM", f"SELECT DISTINCT {U} FROM known_")
)
# Sets take only known users.
for _table in ("first_open", "in_app_purchase", "ads_reward_complete", "user_engagement"):
    _HARD_BASE = _HARD_BASE.replace(
        f"FROM known_ {_table} WHERE", f"FROM {_table} WHERE {U} IS NOT NULL AND"
    )


def _labels(name: str, base: str, cohort: str, acted: str, excluded: str, yes: str, no: str) -> str:
    """Users of ``base`` labelled by left joins to the sets that decide."""
    return f"""
{name} AS (
  SELECT b.{U},
         CASE WHEN c.{U} IS NULL THEN NULL
              WHEN a.{U} IS NOT NULL THEN '{yes}'
              WHEN x.{U} IS NULL THEN '{no}' END AS user_type
  FROM {base} b
  LEFT JOIN {cohort} c ON c.{U} = b.{U}
  LEFT JOIN {acted} a ON a.{U} = b.{U}
  LEFT JOIN {excluded} x ON x.{U} = b.{U}
)"""


_SEGMENTS = ",".join(
    [
        _labels("payer_segments", "engaged", "cohort", "paid", "paid", "iap", "non_iap"),
        _labels(
            "market_payer_segments", "engaged", "market_cohort", "market_paid", "paid",
            "iap", "non_iap",
        ),
        _labels("ad_segments", "engaged_whole", "cohort", "watched", "watched", "adrw", "non_adrw"),
        _labels("ad_segments_any", "engaged", "cohort", "watched", "watched", "adrw", "non_adrw"),
        _labels("ad_lists", "cohort", "cohort", "ever_watched", "ever_watched", "adrw", "non_adrw"),
        _labels(
            "cohort_payers", "cohort", "cohort", "ever_paid", "ever_paid", "iap", "non_iap"
        ),
        f"""
payer_lists AS (
  SELECT {U}, 'iap' AS user_type FROM paid SEMI JOIN cohort USING ({U})
  UNION ALL
  SELECT {U}, 'non_iap' FROM engaged_whole SEMI JOIN cohort USING ({U}) ANTI JOIN paid USING ({U})
)""",
        f"""
market_payer_lists AS (
  SELECT {U}, 'iap' AS user_type FROM market_paid SEMI JOIN market_cohort USING ({U})
  UNION ALL
  SELECT {U}, 'non_iap'
  FROM market_engaged SEMI JOIN market_cohort USING ({U}) ANTI JOIN paid USING ({U})
)""",
        f"""
far_winners AS (
  SELECT DISTINCT {U} FROM win_level SEMI JOIN cohort USING ({U}) WHERE level >= 5 AND {SCOPE}
),
attempts AS (
  SELECT {U}, count(*) AS starts FROM start_level SEMI JOIN far_winners USING ({U})
  WHERE level <= 5 AND {SCOPE} GROUP BY {U}
),
attempt_ratio AS (SELECT {U}, round(starts / 5.0::DOUBLE, 2) AS start_time FROM attempts),
skill_segments AS (
  SELECT {U}, CASE WHEN start_time <= 1.05::DOUBLE THEN 'best'
                   WHEN start_time >= 1.35::DOUBLE THEN 'worst'
                   ELSE 'bete' END AS user_type
  FROM attempt_ratio
),
skill_ends AS (SELECT * FROM skill_segments WHERE user_type <> 'bete')""",
    ]
)


def _sql(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{cte.strip()}" for cte in ctes)
    return f"WITH {_BASE.strip()},{_SEGMENTS}{extra}\n{body.strip()}"


def _intervals(scope: str) -> str:
    return f"""
attempt AS (
  SELECT {U}, level, event_timestamp AS level_start,
         lead(event_timestamp) OVER (PARTITION BY {U} ORDER BY event_timestamp, level)
           AS next_start
  FROM start_level WHERE {U} IS NOT NULL AND {scope}
)"""


_INSIDE = f"""
  p.{U} = a.{U} AND p.event_timestamp >= a.level_start
  AND (a.next_start IS NULL OR p.event_timestamp < a.next_start)"""

_FIRST_PURCHASE = f"""
first_purchase AS (
  SELECT {U}, min(event_timestamp) AS event_timestamp
  FROM in_app_purchase WHERE {SCOPE} GROUP BY {U}
)"""

_ALL_BY_LEVEL = f"""
all_by_level AS (
  SELECT a.level, count(DISTINCT p.{U}) AS num_iap_users, count(*) AS num_purchases
  FROM attempt a JOIN (SELECT * FROM in_app_purchase WHERE {SCOPE}) p ON {_INSIDE}
  GROUP BY a.level
)"""

_FIRST_BY_LEVEL = f"""
first_by_level AS (
  SELECT a.level, count(DISTINCT p.{U}) AS num_first_iap
  FROM attempt a JOIN first_purchase p ON {_INSIDE} GROUP BY a.level
)"""


def _dau_pct(labels: str, yes: str, no: str, sizes: tuple[int, int] | None = None) -> str:
    def size(label: str, fixed: int | None) -> str:
        if fixed is not None:
            return f"{fixed}::DOUBLE"
        return f"(SELECT CAST(count(*) AS DOUBLE) FROM {labels} WHERE user_type = '{label}')"

    first, second = sizes or (None, None)
    return _sql(
        f"""
SELECT event_date,
       nullif(count(DISTINCT {U}) FILTER (user_type = '{yes}'), 0) / {size(yes, first)} * 100
         AS percent_dau_{yes},
       nullif(count(DISTINCT {U}) FILTER (user_type = '{no}'), 0) / {size(no, second)} * 100
         AS percent_dau_{no}
FROM user_engagement JOIN {labels} USING ({U})
WHERE {SCOPE} AND {REGARD} GROUP BY event_date"""
    )


def _outcomes(labels: str) -> str:
    def totals(table: str, name: str, users: bool = False) -> str:
        also = f"count(DISTINCT {U}) AS user_start, " if users else ""
        return f"""
(SELECT user_type AS segment, level, {also}count(*) AS {name}
 FROM {table} JOIN {labels} USING ({U}) GROUP BY ALL)"""

    return f"""
outcomes AS (
  SELECT segment, level, user_start, event_start,
         coalesce(event_win, 0) AS event_win, coalesce(event_lose, 0) AS event_lose
  FROM {totals("start_level", "event_start", users=True)} s
  LEFT JOIN {totals("win_level", "event_win")} w USING (segment, level)
  LEFT JOIN {totals("lose_level", "event_lose")} l USING (segment, level)
),
rates AS (
  SELECT *, event_win::DOUBLE / nullif(event_win + event_lose, 0) AS winrate,
         event_start::DOUBLE / user_start AS apu
  FROM outcomes
)"""


def _rolling(column: str) -> str:
    """Five rows around each one, added up from the first to the last."""
    window = "OVER (PARTITION BY segment ORDER BY level)"
    return (
        f"(lag({column}, 2) {window} + lag({column}, 1) {window} + {column} "
        f"+ lead({column}, 1) {window} + lead({column}, 2) {window}) / 5"
    )


def _winrate(labels: str) -> str:
    return _sql(
        "SELECT segment, level, user_start, event_start, event_win, event_lose, winrate FROM rates",
        _outcomes(labels),
    )


def _winrate_rolling(labels: str) -> str:
    return _sql(
        f"SELECT segment, level, {_rolling('winrate')} AS rolling_winrate "
        "FROM rates WHERE level <= 8",
        _outcomes(labels),
    )


def _apu(labels: str) -> str:
    return _sql(
        f"SELECT segment, level, apu, {_rolling('apu')} AS rolling_apu "
        "FROM rates WHERE level <= 50",
        _outcomes(labels),
    )


def _curves(labels: str) -> str:
    return _sql(
        f"""
SELECT *, {_rolling("winrate")} AS rolling_winrate, {_rolling("apu")} AS rolling_apu
FROM rates WHERE level <= 50""",
        _outcomes(labels),
    )


def _reached(labels: str, yes: str, no: str, yes_name: str, no_name: str) -> str:
    def one(label: str, name: str) -> str:
        return f"""
(SELECT level, count(DISTINCT {U}) AS {name} FROM start_level JOIN {labels} USING ({U})
 WHERE user_type = '{label}' AND {SCOPE} AND {WHOLE} GROUP BY level)"""

    return f"reached AS (SELECT * FROM {one(yes, yes_name)} JOIN {one(no, no_name)} USING (level))"


def _funnel(labels: str, yes: str, no: str) -> str:
    a, b = f"user_{yes}", f"user_{no}"
    return _sql(
        f"""
SELECT r.level, r.{a}, r.{b}, one.{a} AS num_{a}_in_lv1, one.{b} AS num_{b}_in_lv1,
       r.{a}::DOUBLE / one.{a} AS {yes}_drop, r.{b}::DOUBLE / one.{b} AS {no}_drop
FROM reached r LEFT JOIN reached one ON one.level = 1""",
        _reached(labels, yes, no, a, b),
    )


def _kinds(table: str, kind: str, labels: str, what: str, yes: str, no: str) -> str:
    a, b = f"num_{what}_by_{yes}", f"num_{what}_by_{no}"
    return _sql(
        f"""
SELECT {kind}, {a}, {b},
       {a}::DOUBLE / nullif(sum({a}) OVER (), 0)::DOUBLE * 100 AS pct_by_{yes},
       {b}::DOUBLE / nullif(sum({b}) OVER (), 0)::DOUBLE * 100 AS pct_by_{no}
FROM (
  SELECT {kind}, count(DISTINCT {U}) FILTER (user_type = '{yes}') AS {a},
         count(DISTINCT {U}) FILTER (user_type = '{no}') AS {b}
  FROM {table} JOIN {labels} USING ({U}) WHERE {SCOPE} GROUP BY {kind}
)"""
    )


def _usage(table: str, use: str) -> str:
    """Uses per level, counted only where the same user started the level."""

    def of(label: str, column: str) -> str:
        return f"CAST(coalesce(sum({column}) FILTER (user_type = '{label}'), 0) AS BIGINT)"

    def users(label: str) -> str:
        return f"count(DISTINCT {U}) FILTER (user_type = '{label}')"

    return _sql(
        f"""
SELECT *, num_{use}_best::DOUBLE / nullif(num_user_best_start, 0) AS num_{use}_per_best,
       num_{use}_worst::DOUBLE / nullif(num_user_worst_start, 0) AS num_{use}_per_worst
FROM (
  SELECT level,
         {users("best")} AS num_user_best_start, {of("best", "starts")} AS num_start_best,
         {users("worst")} AS num_user_worst_start, {of("worst", "starts")} AS num_start_worst,
         {of("best", "uses")} AS num_{use}_best, {of("worst", "uses")} AS num_{use}_worst
  FROM (SELECT {U}, level, count(*) AS starts FROM start_level GROUP BY ALL)
  LEFT JOIN (SELECT {U}, level, count(*) AS uses FROM {table} GROUP BY ALL) USING ({U}, level)
  LEFT JOIN skill_segments USING ({U})
  WHERE level <= 50 GROUP BY level
)"""
    )


def _pay_counts(labels: str) -> str:
    return f"""
pay_counts AS (
  SELECT user_type AS segment, count(*) FILTER ({U} IN (SELECT {U} FROM paid)) AS num_payer,
         count(*) AS num_user
  FROM {labels} GROUP BY user_type
)"""


_PAY_RATE = """
SELECT segment, num_payer, num_user, num_payer::DOUBLE / num_user * 100 AS pay_rate
FROM pay_counts"""


def _sizes(labels: str) -> str:
    return _sql(
        f"""
SELECT user_type AS segment, count(*) AS num_user,
       count(*)::DOUBLE / (SELECT count(*) FROM {labels}) * 100 AS share_pct
FROM {labels} GROUP BY user_type"""
    )


def _revenue(where: str) -> str:
    amount = "CAST(event_value_in_usd AS DECIMAL(28, 12))"
    return _sql(
        f"""
SELECT country, CAST(sum({amount}) AS DOUBLE) AS revenue,
       CAST(sum({amount}) AS DOUBLE)
         / (SELECT CAST(sum({amount}) AS DOUBLE) FROM in_app_purchase WHERE {where}) * 100
         AS share_pct
FROM in_app_purchase WHERE {where} GROUP BY country"""
    )


def _users(relation: str, label: str) -> str:
    return _sql(f"SELECT {U} FROM {relation} WHERE user_type = '{label}'")


def _first_times(table: str, level: int, yes: str, no: str) -> str:
    return _sql(
        f"""
SELECT {U},
       CASE WHEN acted_at < coalesce(reached_at, acted_at + 1) THEN '{yes}' ELSE '{no}' END
         AS user_type
FROM cohort
LEFT JOIN (SELECT {U}, min(event_timestamp) AS acted_at FROM {table} WHERE {SCOPE}
           GROUP BY {U}) USING ({U})
LEFT JOIN (SELECT {U}, min(event_timestamp) AS reached_at FROM start_level
           WHERE {SCOPE} AND level >= {level} GROUP BY {U}) USING ({U})"""
    )


def _retention(more: str = "") -> str:
    return _sql(
        f"SELECT segment, day_number, retained_users{more} FROM kept",
        f"""
opened AS (SELECT {U}, min(event_date) AS day0 FROM first_open GROUP BY {U}),
kept AS (
  SELECT user_type AS segment, event_date - day0 AS day_number,
         count(DISTINCT {U}) AS retained_users
  FROM skill_segments JOIN opened USING ({U}) JOIN user_engagement USING ({U})
  WHERE event_date BETWEEN day0 AND day0 + 7 GROUP BY ALL
)""",
    )


# Twins that hold for the harder log as they are, by registered name.
HARD = {
    f"hard_{name}": name
    for name in (
        "revenue_by_country",
        "level_outcomes",
        "ads_per_user_by_country",
        "payer_segments",
        "ad_segments",
        "apu_by_payer",
        "winrate_by_payer",
        "purchases_by_level",
        "purchases_vs_first",
        "retention",
        "days_to_first_purchase",
        "user_max_level",
        "level_intervals",
        "first_per_user",
        "booster_by_level_skill",
    )
}

# Queries that drop other players early, and the plain ones they must agree with.
FEW = {
    f"{name}_few_users": name
    for name in (
        "winrate_by_skill",
        "winrate_rolling_by_ad",
        "apu_by_payer",
        "dau_by_payer",
        "level_users_by_ad",
        "booster_by_level_skill",
    )
}


def statements() -> dict[str, str]:
    found = {
        "event_names": _sql(
            """
SELECT DISTINCT CASE event_type WHEN 'view' THEN 'start_level' WHEN 'click' THEN 'win_level'
                WHEN 'error' THEN 'lose_level' WHEN 'purchase' THEN 'in_app_purchase'
                WHEN 'signup' THEN 'booster_use' END AS event_name
FROM log WHERE event_date = DATE '2024-01-15'"""
        ),
        "flatten_event": _sql(
            f"""
SELECT event_timestamp, {U}, event_date, version, country, platform, mobile_name, level
FROM log WHERE event_type = 'view' AND {WHOLE}"""
        ),
        "flatten_purchases": _sql(
            f"""
SELECT event_timestamp, {U}, event_date, version, country, platform, value AS event_value_in_usd
FROM log WHERE event_type = 'purchase' AND {REGARD}"""
        ),
        "dau": _sql(
            f"""
SELECT event_date, version, count(DISTINCT {U}) AS daily_active_users
FROM session_start WHERE platform = 'IOS' GROUP BY ALL"""
        ),
        "dau_by_platform": _sql(
            f"""
SELECT event_date, version, platform, count(DISTINCT {U}) AS daily_active_users
FROM session_start GROUP BY ALL"""
        ),
        "dau_latest": _sql(
            f"""
SELECT event_date, version, platform, count(DISTINCT {U}) AS daily_active_users
FROM session_start GROUP BY ALL ORDER BY event_date DESC, version, platform LIMIT 100"""
        ),
        "users_by_country": _sql(
            f"""
SELECT country, count(DISTINCT {U}) AS num_user FROM user_engagement WHERE {SCOPE}
GROUP BY country HAVING num_user > 3"""
        ),
        "new_users": _sql("SELECT count(*) AS num_user FROM cohort"),
        "engaged_non_payers": _sql(
            f"SELECT count(*) AS num_user FROM market_engaged ANTI JOIN paid USING ({U})"
        ),
        "dau_by_payer": _sql(
            f"""
SELECT event_date, nullif(count(DISTINCT {U}) FILTER (user_type = 'iap'), 0) AS dau_iap,
       nullif(count(DISTINCT {U}) FILTER (user_type = 'non_iap'), 0) AS dau_non_iap
FROM user_engagement JOIN cohort_payers USING ({U}) WHERE {SCOPE} AND {REGARD}
GROUP BY event_date"""
        ),
        "dau_pct_by_payer": _dau_pct("payer_segments", "iap", "non_iap"),
        "dau_pct_by_payer_fixed": _dau_pct("payer_segments", "iap", "non_iap", (15, 2091)),
        "dau_pct_by_ad": _dau_pct("ad_segments", "adrw", "non_adrw"),
        "dau_pct_by_skill": _dau_pct("skill_segments", "best", "worst"),
        "retention": _retention(),
        "retention_rate": _retention(
            ", retained_users::DOUBLE / max(retained_users) FILTER (day_number = 0) "
            "OVER (PARTITION BY segment) AS retention_rate"
        ),
        "pay_rate_by_country": _sql(
            f"""
SELECT country, num_user, num_iap, num_iap::DOUBLE / num_user AS pay_rate
FROM (SELECT country, count(DISTINCT {U}) AS num_user FROM user_engagement
      WHERE {SCOPE} GROUP BY country)
LEFT JOIN (SELECT country, count(DISTINCT {U}) AS num_iap FROM in_app_purchase
           WHERE {SCOPE} GROUP BY country) USING (country)
WHERE num_user > 3"""
        ),
        "revenue_by_country": _revenue(SCOPE),
        "revenue_by_market": _revenue(f"{SCOPE} AND {IN_MARKETS}"),
        "first_purchase_by_level": _sql(
            "SELECT * FROM first_by_level", _intervals(SCOPE), _FIRST_PURCHASE, _FIRST_BY_LEVEL
        ),
        "purchases_by_level": _sql("SELECT * FROM all_by_level", _intervals(SCOPE), _ALL_BY_LEVEL),
        "purchases_vs_first": _sql(
            """
SELECT level, coalesce(num_iap_users, 0) AS num_iap_users,
       coalesce(num_purchases, 0) AS num_purchases, coalesce(num_first_iap, 0) AS num_first_iap
FROM (SELECT * FROM all_by_level WHERE level < 200)
FULL JOIN (SELECT * FROM first_by_level WHERE level < 200) USING (level)""",
            _intervals(SCOPE),
            _FIRST_PURCHASE,
            _ALL_BY_LEVEL,
            _FIRST_BY_LEVEL,
        ),
        "payer_count": _sql(f"SELECT count(DISTINCT {U}) AS num_user FROM in_app_purchase"),
        "days_to_first_purchase": _sql(
            f"""
SELECT date_sub('day', make_timestamp(f.event_timestamp), make_timestamp(p.event_timestamp))
         AS days, count(DISTINCT {U}) AS num_users
FROM (SELECT * FROM first_open WHERE {SCOPE}) f JOIN first_purchase p USING ({U})
GROUP BY days""",
            _FIRST_PURCHASE,
        ),
        "pay_counts_by_ad": _sql(
            """
SELECT segment || '_iap' AS metric, num_payer AS num_user FROM pay_counts
UNION ALL SELECT segment, num_user FROM pay_counts""",
            _pay_counts("ad_lists"),
        ),
        "pay_rate_by_ad": _sql(_PAY_RATE, _pay_counts("ad_lists")),
        "pay_rate_by_skill": _sql(_PAY_RATE, _pay_counts("skill_ends")),
        "paying_ad_users": _sql(
            f"""
SELECT count(*) AS num_user FROM paid
SEMI JOIN (SELECT {U} FROM ad_lists WHERE user_type = 'adrw') USING ({U})"""
        ),
        "cohort": _sql(f"SELECT {U} FROM cohort"),
        "cohort_split_counts": _sql(
            "SELECT user_type, count(*) AS num_user FROM cohort_payers GROUP BY user_type"
        ),
        "payer_users": _users("payer_lists", "iap"),
        "payer_users_by_market": _users("market_payer_lists", "iap"),
        "non_payer_users": _users("payer_lists", "non_iap"),
        "non_payer_users_by_market": _users("market_payer_lists", "non_iap"),
        "payer_segments": _sql("SELECT * FROM payer_segments"),
        "payer_segments_by_market": _sql("SELECT * FROM market_payer_segments"),
        "ad_users": _users("ad_lists", "adrw"),
        "non_ad_users": _users("ad_lists", "non_adrw"),
        "ad_segments": _sql("SELECT * FROM ad_segments"),
        "segment_sizes": _sizes("payer_lists"),
        "segment_sizes_by_ad": _sizes("ad_lists"),
        "segment_sizes_by_skill": _sizes("skill_segments"),
        "attempt_ratio": _sql("SELECT * FROM attempt_ratio"),
        "attempt_ratio_fine": _sql(
            f"SELECT {U}, round(starts / 5.0::DOUBLE, 4) AS start_time FROM attempts"
        ),
        "skill_segments": _sql("SELECT * FROM skill_segments"),
        "booster_segments": _sql(
            f"""
SELECT {U}, CASE WHEN coalesce(uses, 0) >= 3 THEN 'booster' ELSE 'non_booster' END AS user_type
FROM cohort
LEFT JOIN (SELECT {U}, count(*) AS uses FROM booster_use WHERE {SCOPE} GROUP BY {U}) USING ({U})"""
        ),
        "early_ad_segments": _first_times("ads_reward_complete", 5, "adrw", "non_adrw"),
        "early_payer_segments": _sql(
            f"""
SELECT {U}, CASE WHEN date_sub('day', make_timestamp(f.event_timestamp),
                               make_timestamp(p.event_timestamp)) <= 7
            THEN 'iap' ELSE 'non_iap' END AS user_type
FROM cohort JOIN first_open f USING ({U}) LEFT JOIN first_purchase p USING ({U})""",
            _FIRST_PURCHASE,
        ),
        "early_payer_level_segments": _first_times("in_app_purchase", 10, "iap", "non_iap"),
        "user_max_level": _sql(
            f"SELECT {U}, max(level) AS max_level FROM start_level WHERE {U} IS NOT NULL GROUP BY {U}"
        ),
        "user_max_level_of_one": _sql(
            f"SELECT {U}, max(level) AS max_level FROM start_level WHERE {U} = '1' GROUP BY {U}"
        ),
        "level_outcomes": _sql(
            f"""
SELECT level, user_start, event_start, coalesce(event_win, 0) AS event_win,
       coalesce(event_lose, 0) AS event_lose
FROM (SELECT level, count(DISTINCT {U}) AS user_start, count(*) AS event_start
      FROM start_level GROUP BY level)
LEFT JOIN (SELECT level, count(*) AS event_win FROM win_level GROUP BY level) USING (level)
LEFT JOIN (SELECT level, count(*) AS event_lose FROM lose_level GROUP BY level) USING (level)"""
        ),
        "funnel_by_payer": _funnel("payer_segments", "iap", "non_iap"),
        "funnel_by_ad": _funnel("ad_lists", "adrw", "non_adrw"),
        "funnel_by_skill": _funnel("skill_segments", "best", "worst"),
        "level_users_by_ad": _sql(
            """
SELECT level, user_ad_rw, user_non_ad_rw, user_ad_rw + user_non_ad_rw AS total,
       user_ad_rw::DOUBLE / (user_ad_rw + user_non_ad_rw) * 100 AS ad_rw_pct,
       user_non_ad_rw::DOUBLE / (user_ad_rw + user_non_ad_rw) * 100 AS non_ad_rw_pct
FROM reached WHERE level < 200""",
            _reached("ad_lists", "adrw", "non_adrw", "user_ad_rw", "user_non_ad_rw"),
        ),
        "attempt_ratio_distribution": _sql(
            """
SELECT start_time, count(*) AS num_user FROM attempt_ratio WHERE start_time >= 1
GROUP BY start_time"""
        ),
        "attempt_ratio_cumulative": _sql(
            """
SELECT *, CASE WHEN pct_accumulate <= 35 THEN 'low' WHEN pct_accumulate >= 75 THEN 'high'
          ELSE 'mid' END AS band
FROM (
  SELECT s.start_time, s.num_user, CAST(sum(t.num_user) AS BIGINT) AS accumulate,
         round(100.0::DOUBLE * sum(t.num_user)::DOUBLE
               / (SELECT sum(num_user) FROM spread)::DOUBLE, 2) AS pct_accumulate
  FROM spread s JOIN spread t ON t.start_time <= s.start_time GROUP BY s.start_time, s.num_user
)""",
            """
spread AS (
  SELECT start_time, count(*) AS num_user FROM attempt_ratio WHERE start_time >= 1
  GROUP BY start_time
)""",
        ),
        "ad_placement_by_payer": _kinds(
            "ads_reward_complete", "placement", "payer_segments", "ads", "iap", "non_iap"
        ),
        "booster_type_by_payer": _kinds(
            "booster_use", "booster_type", "payer_segments", "booster", "iap", "non_iap"
        ),
        "booster_type_by_ad": _kinds(
            "booster_use", "booster_type", "ad_segments_any", "booster", "adrw", "non_adrw"
        ),
        "ads_per_user_by_country": _sql(
            f"""
SELECT country, num_ad_rw, num_ad_rw::DOUBLE / num_user AS ad_per_user
FROM (SELECT country, count(*) AS num_ad_rw FROM ads_reward_complete
      WHERE {SCOPE} GROUP BY country)
JOIN (SELECT country, count(DISTINCT {U}) AS num_user FROM start_level
      WHERE {SCOPE} GROUP BY country) USING (country)
WHERE num_ad_rw > 1"""
        ),
        "booster_by_level_skill": _usage("booster_use", "booster"),
        "ad_by_level_skill": _usage("af_rewarded", "adrw"),
        "overall_usage_by_skill": _sql(
            f"""
SELECT user_type AS segment, sum(boosters)::DOUBLE / count(*) AS booster_per,
       sum(ads)::DOUBLE / count(*) AS adrw_per
FROM (
  SELECT user_type, {U}, level,
         (SELECT count(*) FROM booster_use b WHERE b.{U} = s.{U} AND b.level = s.level) AS boosters,
         (SELECT count(*) FROM af_rewarded r WHERE r.{U} = s.{U} AND r.level = s.level) AS ads
  FROM (SELECT DISTINCT {U}, level FROM start_level) s JOIN skill_ends USING ({U})
)
GROUP BY user_type"""
        ),
        "in_users": _sql(
            f"""
SELECT level, count(*) AS count FROM start_level
WHERE {U} IN (SELECT {U} FROM payer_lists WHERE user_type = 'iap') GROUP BY level"""
        ),
        "not_in_users": _sql(
            f"""
SELECT platform, count(DISTINCT {U}) AS num_user FROM user_engagement
WHERE {U} NOT IN (SELECT {U} FROM in_app_purchase) GROUP BY platform"""
        ),
        "memberships": _sql(
            f"""
SELECT {U}, {U} IN (SELECT {U} FROM win_level) AS won,
       {U} IN (SELECT {U} FROM in_app_purchase) AS paid,
       {U} IN (SELECT {U} FROM ads_reward_complete) AS watched
FROM (SELECT {U} FROM win_level UNION SELECT {U} FROM in_app_purchase
      UNION SELECT {U} FROM ads_reward_complete)"""
        ),
        "merge_by_level": _sql(
            f"""
SELECT level, coalesce(num_booster, 0) AS num_booster, coalesce(num_adrw, 0) AS num_adrw
FROM (SELECT level, count(*) AS num_booster FROM booster_use WHERE {SCOPE} GROUP BY level)
FULL JOIN (SELECT level, count(*) AS num_adrw FROM af_rewarded WHERE {SCOPE} GROUP BY level)
  USING (level)"""
        ),
        "pivot_labels": _sql(
            """
SELECT event_date, max(event_value_in_usd) FILTER (platform = 'IOS') AS max_ios,
       max(event_value_in_usd) FILTER (platform = 'ANDROID') AS max_android
FROM in_app_purchase GROUP BY event_date"""
        ),
        "first_per_user": _sql(
            f"""
SELECT {U}, event_timestamp, event_value_in_usd FROM in_app_purchase WHERE {U} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {U} ORDER BY event_timestamp, event_value_in_usd) = 1"""
        ),
        "level_intervals": _sql("SELECT * FROM attempt", _intervals("true")),
        "attribute_to_level": _sql(
            f"""
SELECT a.{U}, a.level, count(*) AS purchases FROM attempt a JOIN in_app_purchase p ON {_INSIDE}
GROUP BY ALL""",
            _intervals("true"),
        ),
    }
    for name, labels in (("payer", "payer_lists"), ("ad", "ad_lists"), ("skill", "skill_ends")):
        found[f"winrate_by_{name}"] = _winrate(labels)
        found[f"winrate_rolling_by_{name}"] = _winrate_rolling(labels)
        found[f"apu_by_{name}"] = _apu(labels)
        found[f"level_curves_by_{name}"] = _curves(labels)
    found["apu_by_payer_all_levels"] = _apu("payer_lists").replace(" WHERE level <= 50", "")
    found["attempt_ratio_cumulative_half_even"] = found["attempt_ratio_cumulative"].replace(
        "round(100.0::DOUBLE", "round_even(100.0::DOUBLE"
    )
    found["flatten_int_slot"] = found["flatten_event"]
    found["winrate_by_skill_bucketed"] = found["winrate_by_skill"]
    found |= {f"{name}_bloom": found[name] for name in ("winrate_by_skill", "dau_by_payer", "retention")}
    found["users_by_platform_sketch"] = _sql(
        f"""
SELECT platform, count(DISTINCT {U}) AS num_user, true AS near
FROM session_start WHERE {REGARD} GROUP BY platform"""
    )
    found["weekly_users_sketch"] = _sql(
        f"""
SELECT window_end, count(DISTINCT {U}) AS num_user, true AS near
FROM (SELECT DISTINCT event_date AS window_end FROM session_start)
JOIN session_start ON event_date BETWEEN window_end - 6 AND window_end GROUP BY window_end"""
    )
    found["stored_event_names"] = found["event_names"]
    found["stored_level_outcomes"] = (
        found["level_outcomes"]
        .replace("FROM start_level GROUP", f"FROM start_level WHERE {WHOLE} GROUP")
        .replace("FROM win_level GROUP", f"FROM win_level WHERE {WHOLE} GROUP")
        .replace("FROM lose_level GROUP", f"FROM lose_level WHERE {WHOLE} GROUP")
    )
    found["level_outcomes_in_two_runs"] = found["level_outcomes"]
    found |= {few: found[name] for few, name in FEW.items()}
    return found | {hard: _on_hard_log(found[name]) for hard, name in HARD.items()}


def _on_hard_log(sql: str) -> str:
    """A statement over the harder log, without the cuts at level 50 and 200 that it has plenty of."""
    hard = sql.replace(_BASE.strip(), _HARD_BASE.strip())
    for cut in (" WHERE level <= 50", " WHERE level < 200", "  WHERE level <= 50"):
        hard = hard.replace(cut, "")
    return hard
