"""Common table expressions of the SQL counterparts."""

from recordrisk.functions import tables as R
from recordrisk.sources import views as V


def quoted(text):
    return "'" + str(text).replace("'", "''") + "'"


def in_list(values):
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def hash60(*parts):
    """First 60 bits of md5; parts are SQL expressions, joined by a colon."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def rules_case(text, rules, default):
    """A CASE over an ordered keyword table."""
    lit = (lambda v: quoted(v)) if isinstance(default, str) else str
    whens = " ".join(
        "WHEN " + " OR ".join(f"{text} LIKE {quoted('%' + w + '%')}" for w in words) + f" THEN {lit(result)}"
        for result, words in rules)
    return f"CASE {whens} ELSE {lit(default)} END"


def map_case(col, mapping, default="NULL"):
    lit = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return f"CASE {' '.join(f'WHEN {col} = {lit(k)} THEN {lit(v)}' for k, v in mapping.items())} ELSE {default} END"


def stage_case(col="Stage", rules="train"):
    if rules == "train":
        return rules_case(f"lower(trim(coalesce({col}, '')))", R.STAGE_RULES_TRAIN, R.STAGE_DEFAULT)
    return rules_case(f"lower(coalesce({col}, ''))", R.STAGE_RULES_SERVE, R.STAGE_DEFAULT)


def industry_case(col="Industry", rules="train"):
    if rules == "train":
        return rules_case(f"lower(trim(coalesce({col}, '')))", R.INDUSTRY_RULES_TRAIN, R.INDUSTRY_DEFAULT_TRAIN)
    return rules_case(f"lower(coalesce({col}, ''))", R.INDUSTRY_RULES_SERVE, R.INDUSTRY_DEFAULT_SERVE)


def band_case(col):
    whens = " ".join(f"WHEN {col} < {e} THEN {i}" for i, e in enumerate(R.FUNDING_BAND_EDGES, 1))
    return f"CASE WHEN {col} = 0 THEN 0 {whens} ELSE {len(R.FUNDING_BAND_EDGES) + 1} END"


MONEY = "CAST(replace(CASE WHEN TotalFunding = '-' THEN '0' ELSE TotalFunding END, ',', '') AS DOUBLE)"
CITY_FIXED = map_case("City", R.CITY_FIXES, "City")

RECORDS = f"""
records AS (
  SELECT o_orderkey AS id, concat('Record#', CAST(o_orderkey AS VARCHAR)) AS Startup, r_name AS Country,
    nullif(split_part({quoted(V.CITIES)}, '|', n_nationkey + 1), '') AS City,
    nullif(split_part({quoted(V.INDUSTRIES)}, '|', CAST(o_orderkey % 22 AS INT) + 1), '') AS Industry,
    nullif(split_part({quoted(V.STAGES)}, '|', CAST(o_orderkey % 18 AS INT) + 1), '') AS Stage,
    CASE WHEN o_orderkey % 17 = 0 THEN '-' WHEN o_orderkey % 101 = 0 THEN NULL
      ELSE format('{{:,.2f}}', o_totalprice * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 10 ELSE 100 END)) END
      AS TotalFunding,
    n_lines AS FundingRounds, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS FoundedAt,
    CAST(CAST(first_ship AS DATE) AS VARCHAR) AS FirstFundingAt,
    CAST(CAST(last_ship AS DATE) AS VARCHAR) AS LastFundingAt,
    CASE WHEN o_orderstatus = 'O' THEN 'operating' WHEN o_orderstatus = 'F' THEN 'closed'
      WHEN o_orderkey % 2 = 0 THEN 'acquired' ELSE 'ipo' END AS Status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
             FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey)"""

MASTER = RECORDS + f""",
master AS (
  SELECT id, City, Industry, Stage, {MONEY} AS TotalFunding, CAST(FundingRounds AS DOUBLE) AS FundingRounds,
    CASE WHEN Status = 'closed' THEN 0 ELSE 1 END AS StatusCode,
    CASE WHEN Status = 'closed' THEN 'Failed' ELSE 'Safe' END AS Status
  FROM records)"""

FEATURES = MASTER + f""",
fixed AS (SELECT * REPLACE ({CITY_FIXED} AS City), {industry_case()} AS IndustryClean,
  {stage_case()} AS StageEncoded FROM master),
frequent AS (SELECT City AS kept FROM fixed WHERE City IS NOT NULL GROUP BY City
  ORDER BY count(*) DESC, City LIMIT 15),
folded AS (SELECT fixed.* REPLACE (CASE WHEN kept IS NULL THEN 'Other' ELSE City END AS City)
  FROM fixed LEFT JOIN frequent ON City = kept),
city_codes AS (SELECT City AS value, CAST(row_number() OVER (ORDER BY City) - 1 AS INT) AS code
  FROM (SELECT DISTINCT City FROM folded)),
industry_codes AS (SELECT IndustryClean AS value, CAST(row_number() OVER (ORDER BY IndustryClean) - 1 AS INT) AS code
  FROM (SELECT DISTINCT IndustryClean FROM folded)),
cap AS (SELECT quantile_cont(TotalFunding, 0.99) AS c FROM master),
capped AS (SELECT folded.* REPLACE (CASE WHEN TotalFunding > c THEN c ELSE TotalFunding END AS TotalFunding,
  greatest(coalesce(FundingRounds, 1.0), 1.0) AS FundingRounds) FROM folded, cap),
features AS (
  SELECT id, StatusCode, Status, City, IndustryClean, TotalFunding, FundingRounds,
    TotalFunding / FundingRounds AS FundingPerRound, ln(1 + TotalFunding) AS LogFunding,
    ln(1 + TotalFunding / FundingRounds) AS LogFundingPerRound, StageEncoded,
    cc.code AS CityEncoded, ic.code AS IndustryEncoded,
    CASE WHEN City IN {in_list(R.MAJOR_CITIES)} THEN 1 ELSE 0 END AS IsMajorCity,
    CASE WHEN IndustryClean IN {in_list(R.TECH_INDUSTRIES)} THEN 1 ELSE 0 END AS IsTechIndustry,
    {band_case('TotalFunding')} AS FundingBand
  FROM capped JOIN city_codes cc ON City = cc.value JOIN industry_codes ic ON IndustryClean = ic.value)"""

HISTORY = f"""
history AS (
  SELECT event_id AS pred_id, CAST(floor(value * 10000) AS BIGINT) AS Funding, CAST(event_id % 6 AS INT) AS Rounds,
    split_part({quoted(V.LOG_CITIES)}, '|', CAST(user_id % 5 AS INT) + 1) AS City,
    {map_case('event_type', V.LOG_INDUSTRIES, quoted('Other'))} AS Industry,
    split_part({quoted(V.LOG_STAGES)}, '|', CAST(event_id % 4 AS INT) + 1) AS Stage,
    CASE WHEN floor(value * 10000) > {R.RULE_THRESHOLD} THEN 'Safe' ELSE 'Failed' END AS Prediction,
    round(CAST(0.5 AS DOUBLE) + (event_id % 500) / CAST(1000 AS DOUBLE), 4) AS Confidence
  FROM events)"""

SCORES = """
scores AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS label,
    CASE WHEN round(o_totalprice / 500000, 4) > 0.5 THEN 1 ELSE 0 END AS prediction,
    round(o_totalprice / 500000, 4) AS score
  FROM orders)"""

ROUNDED_FEATURES = """
  id, round(TotalFunding, 4) AS TotalFunding, FundingRounds, round(FundingPerRound, 7) AS FundingPerRound,
  round(LogFunding, 6) AS LogFunding, round(LogFundingPerRound, 6) AS LogFundingPerRound, StageEncoded,
  CityEncoded, IndustryEncoded, IsMajorCity, IsTechIndustry, FundingBand"""


def reason_sql(style="service", industry="Industry", stage="Stage"):
    """Reason text from the log columns, written with printf and list functions."""
    bad = R.FAILED_REASONS_BY_STYLE[style]
    m = "(CAST(Funding AS DOUBLE) / 1000000)"
    major, tech = f"City IN {in_list(R.MAJOR_CITIES)}", f"{industry} IN {in_list(R.TECH_INDUSTRIES)}"

    def has(words):
        return " OR ".join(f"lower({stage}) LIKE {quoted('%' + w + '%')}" for w in words) or "false"

    def fill(template, **slots):
        text = quoted(template.replace("{symbol}", "$"))
        for name, expr in slots.items():
            text = f"replace({text}, '{{{name}}}', CAST({expr} AS VARCHAR))"
        return text

    g, f = R.SAFE_REASONS, R.FAILED_REASONS
    safe = f"""[CASE WHEN {m} >= 10 THEN {fill(g['strong'], amount=f"printf('%.1f', {m})")}
      WHEN {m} >= 1 THEN {fill(g['solid'], amount=f"printf('%.1f', {m})")} ELSE {quoted(g['early'])} END,
      CASE WHEN Rounds >= 3 THEN {fill(g['many_rounds'], rounds='Rounds')}
        WHEN Rounds >= 2 THEN {fill(g['some_rounds'], rounds='Rounds')} END,
      CASE WHEN {major} THEN {fill(g['city'], city='City')} END,
      CASE WHEN {tech} THEN {fill(g['tech'], industry=industry)} END,
      CASE WHEN {has(R.LATE_STAGE_WORDS[style])} THEN {quoted(g['late'])} END]"""
    failed = f"""[CASE WHEN {m} < 0.1 THEN {quoted(f['none'])}
      WHEN {m} < 0.5 THEN {fill(f['little'], amount=f"printf('%.2f', {m})")} END,
      CASE WHEN Rounds <= 1 THEN {quoted(f['rounds'])} END,
      CASE WHEN NOT ({major}) THEN {fill(bad['city'], city='City')} END,
      CASE WHEN NOT ({tech}) THEN {fill(bad['industry'], industry=industry)} END,
      CASE WHEN {has(R.STRESS_STAGE_WORDS[style])} THEN {quoted(f['debt'])} END]"""

    def sentence(prefix, parts, joiner):
        kept = f"[p FOR p IN {parts} IF p IS NOT NULL]"
        return f"{quoted(prefix)} || coalesce(nullif(array_to_string(({kept})[1:3], {quoted(joiner)}), ''), {quoted(R.REASON_FALLBACK)}) || '.'"

    return (f"CASE WHEN Prediction = 'Safe' THEN {sentence(R.SAFE_PREFIX, safe, R.SAFE_JOIN)} "
            f"ELSE {sentence(R.FAILED_PREFIX, failed, R.FAILED_JOIN)} END")


def advice_sql(style="service"):
    m = "(CAST(Funding AS DOUBLE) / 1000000)"
    good, bad = R.SAFE_ADVICE[style], R.FAILED_ADVICE[style]
    return f"""CASE WHEN Prediction = 'Safe' THEN
      CASE WHEN {m} < 1 THEN {quoted(good[0])} WHEN {m} < 5 THEN {quoted(good[1])}
        WHEN Rounds < 3 THEN {quoted(good[2])} ELSE {quoted(good[3])} END
    ELSE CASE WHEN {m} < 0.5 THEN {quoted(bad[0])} WHEN Rounds <= 1 THEN {quoted(bad[1])}
        WHEN City NOT IN {in_list(R.MAJOR_CITIES)} THEN {quoted(bad[2])} ELSE {quoted(bad[3])} END END"""
