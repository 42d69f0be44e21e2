"""The queries as SQL over the same tables."""

from __future__ import annotations

from registry import roles

ORACLE: dict[str, str] = {}

W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def r(col: str, digits: int = 6, alias: str | None = None) -> str:
    name = col if col.isidentifier() else f'"{col}"'
    return f"round({name}, {digits}) + 0.0 AS {alias or name}"


EXACT = {"open", "high", "low", "close", "ldcp", "true_range", "lowest", "highest"}


def rs(cols, digits: int = 6) -> str:
    return ", ".join(r(c, 8 if c in EXACT else digits) for c in cols)


def even(x: str, digits: int) -> str:
    """Scale, nearest integer with ties to even, scale back."""
    y = f"(({x}) * {10 ** digits}.0::DOUBLE)"
    return f"(CASE WHEN abs({y} - trunc({y})) = 0.5 THEN 2 * round({y} / 2) ELSE round({y}) END / {10 ** digits}.0::DOUBLE)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OHLC = ("open", "high", "low", "close", "volume")

# -- prices -------------------------------------------------------------------------

BARS = """
lines AS (
    SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / nullif(l_quantity, 0) AS price,
           row(l_orderkey * 10 + l_linenumber, l_extendedprice, l_quantity) AS ord,
           CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0.0 END AS traded
    FROM lineitem JOIN part ON l_partkey = p_partkey
),
bars AS (
    SELECT ticker, date, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, ord) AS close, sum(traded) AS volume
    FROM lines GROUP BY ticker, date
)"""
CHANGED = BARS + f""",
changed0 AS (SELECT *, lag(close) OVER w AS ldcp FROM bars {W}),
changed AS (
    SELECT *, {even('change / ldcp * 100', 2)} AS change_pct FROM (SELECT *, {even('close - ldcp', 2)} AS change FROM changed0)
)"""
CLEAN = CHANGED + """,
clean AS (SELECT * FROM changed WHERE open > 0 AND volume > 0)"""


def ema_sql(span: int) -> str:
    a = f"(2.0::DOUBLE / {span + 1})"
    q = f"(1.0::DOUBLE - {a})"
    return (
        f"pow({q}, rn - 1) * sum(CASE WHEN rn = 1 THEN close ELSE {a} * close END * pow({q}, 1 - rn)) "
        "OVER (PARTITION BY ticker ORDER BY date)"
    )


def full(agg: str, col: str, n: int, start: int | None = None) -> str:
    """Aggregate over the last n rows, NULL unless all values are there."""
    frame = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {frame} = {n} THEN {agg}({col}) OVER {frame} END"


INDICATORS = CLEAN + f""",
i0 AS (
    SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, close - lag(close) OVER w AS delta,
           (high + low + close) / 3 AS tp,
           high - lag(high) OVER w AS up, lag(low) OVER w - low AS down,
           close / lag(close) OVER w - 1 AS ret
    FROM clean {W}
),
i1 AS (
    SELECT *, CASE WHEN delta > 0 THEN delta WHEN delta <= 0 THEN 0.0 END AS gain,
           CASE WHEN delta < 0 THEN -delta WHEN delta >= 0 THEN 0.0 END AS loss,
           greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range,
           CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus,
           CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus
    FROM i0
),
i2 AS (
    SELECT *, {full('avg', 'gain', 14)} AS gains, {full('avg', 'loss', 14)} AS losses,
           {full('avg', 'tp', 20)} AS tp_mean, list(tp) OVER f20 AS tps,
           {full('avg', 'true_range', 14)} AS atr14,
           {full('avg', 'plus', 14)} AS pm, {full('avg', 'minus', 14)} AS mm,
           {full('avg', 'close', 20)} AS bb_mid, {full('stddev_pop', 'close', 20)} AS sd,
           avg(ret) OVER f251 AS mu, stddev_pop(ret) OVER f251 AS sigma, count(ret) OVER f251 AS seen,
           {ema_sql(12)} AS ema_12, {ema_sql(26)} AS ema_26, {ema_sql(9)} AS ema_9, {ema_sql(21)} AS ema_21,
           {ema_sql(50)} AS ema_50, {ema_sql(200)} AS ema_200
    FROM i1
    WINDOW f20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
           f251 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND 1 PRECEDING)
),
i3 AS (
    SELECT *, ema_12 - ema_26 AS macd, 100 - 100 / (1 + gains / nullif(losses, 0)) AS rsi,
           (tp - tp_mean) / (0.015 * nullif(list_avg(list_transform(tps, lambda x: abs(x - tp_mean))), 0)) AS cci,
           100 * pm / nullif(atr14, 0) AS pdi, 100 * mm / nullif(atr14, 0) AS mdi,
           bb_mid + 2 * sd AS bb_upper, bb_mid - 2 * sd AS bb_lower,
           CASE WHEN seen = 251 AND sigma <> 0 AND ret IS NOT NULL THEN pow((ret - mu) / sigma, 2) ELSE 0.0 END AS turbulence
    FROM i2
),
ind AS (
    SELECT *, 100 * abs(pdi - mdi) / nullif(pdi + mdi, 0) AS dmi_dx,
           nullif(bb_upper - bb_lower, 0) / nullif(bb_mid, 0) AS bb_width,
           (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_pct
    FROM i3
)"""
INDICATOR_COLUMNS = (
    "macd", "rsi", "cci", "dmi_dx", "ema_9", "ema_21", "ema_50", "ema_200",
    "bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct", "turbulence",
)
NOT_NULL = " AND ".join(
    f"{c} IS NOT NULL" for c in (*INDICATOR_COLUMNS, "ldcp", "change", "change_pct", *OHLC)
)
SURVIVORS = INDICATORS + f""",
surv AS (SELECT * FROM ind WHERE rn > 252 AND {NOT_NULL})"""


def clip_sql(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {lo}), {hi}) END"


def features_over(source: str) -> str:
    """CTEs f0..f2 with the window features of a table."""
    return f""",
f0 AS (
    SELECT *, {clip_sql('ln(close / ldcp)', -0.15, 0.15)} AS ret_1d,
           {clip_sql('ln(close / lag(close, 5) OVER w)', -0.4, 0.4)} AS ret_5d,
           {clip_sql('ln(close / lag(close, 10) OVER w)', -0.5, 0.5)} AS ret_10d,
           {clip_sql('ln(close / lag(close, 20) OVER w)', -0.6, 0.6)} AS ret_20d,
           nullif({full('avg', 'volume', 5)}, 0) AS v5, nullif({full('avg', 'volume', 20)}, 0) AS v20,
           {clip_sql('close / (' + full('max', 'close', 126) + ') - 1', -1, 0)} AS high_ratio,
           {clip_sql('close / (' + full('min', 'close', 126) + ') - 1', 0, 3)} AS low_ratio,
           ln(lead(close, 5) OVER w / close) AS next_ret
    FROM {source} {W}
),
f1 AS (
    SELECT *, {full('stddev_samp', 'ret_1d', 5)} AS vol_5, {full('stddev_samp', 'ret_1d', 10)} AS rolling_vol_10,
           {full('stddev_samp', 'ret_1d', 20)} AS rolling_vol_20,
           {clip_sql('volume / v5', 0, 10)} AS volume_ma5_ratio, {clip_sql('volume / v20', 0, 10)} AS volume_ma20_ratio,
           {clip_sql('ln(v5 / v20)', -2, 2)} AS volume_trend, nullif(high - low, 0) AS span
    FROM f0
),
f2 AS (
    SELECT *, {clip_sql('vol_5 / nullif(rolling_vol_20, 0)', 0, 5)} AS vol_ratio_5_20,
           {clip_sql('(high - close) / span', 0, 1)} AS close_to_high, {clip_sql('(close - low) / span', 0, 1)} AS close_to_low,
           {clip_sql('span / close', 0, 0.2)} AS high_low_range_pct, {clip_sql('open / ldcp - 1', -0.5, 0.5)} AS gap_pct,
           CASE WHEN close / ldcp > 1.045 THEN 1 ELSE 0 END AS near_upper_circuit,
           CASE WHEN close / ldcp < 0.955 THEN 1 ELSE 0 END AS near_lower_circuit,
           isodow(date) - 1 AS day_of_week, month(date) AS month
    FROM f1
)"""


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def windowed(name: str, ctes: str, source: str, cols, digits: int = 6, where: str = "") -> None:
    ORACLE[name] = select(ctes, f"SELECT ticker, date, {rs(cols, digits)} FROM {source} {where}")


windowed("read_bars", BARS, "bars", OHLC)
windowed("clean_bars", BARS, "bars", OHLC, where="WHERE open > 0 AND volume > 0")
windowed("project_reorder", BARS, "bars", OHLC)
windowed("date_range_mask", BARS, "bars", ["close"], where="WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'")
windowed("drop_incomplete", CHANGED, "changed", ["ldcp", "close"], where="WHERE ldcp IS NOT NULL")
ORACLE["drop_warmup"] = select(CHANGED, f"""SELECT ticker, date, {rs(['ldcp', 'close'])} FROM (
    SELECT *, row_number() OVER w AS rn FROM changed {W}) WHERE rn > 252 AND ldcp IS NOT NULL""")
ORACLE["row_offset"] = select(BARS, f"""SELECT ticker, date, {rs(['close'])} FROM (
    SELECT *, row_number() OVER w AS rn FROM bars {W}) WHERE rn > 100""")
windowed("ldcp_change", CHANGED, "changed", ["ldcp", "close", "change", "change_pct"], 4)
windowed("ema", INDICATORS, "ind", ["ema_9", "ema_21", "ema_50", "ema_200"], 4)
windowed("macd", INDICATORS, "ind", ["macd"], 4)
windowed("rsi", INDICATORS, "ind", ["rsi"])
windowed("cci", INDICATORS, "ind", ["cci"])
windowed("true_range", INDICATORS, "ind", ["true_range", "atr14"])
windowed("dmi_dx", INDICATORS, "ind", ["dmi_dx"])
windowed("bollinger", INDICATORS, "ind", ["bb_mid", "bb_upper", "bb_lower", "bb_width", "bb_pct"])
windowed("turbulence", INDICATORS, "ind", ["turbulence"])
windowed("technical_indicators", SURVIVORS, "surv", ["close", *INDICATOR_COLUMNS], 4)

CLEAN_FEATURES = CLEAN + features_over("clean")
windowed("log_returns", CLEAN_FEATURES, "f2", ["ret_1d", "ret_5d", "ret_10d", "ret_20d"])
windowed("rolling_vol", CLEAN_FEATURES, "f2", ["rolling_vol_10", "rolling_vol_20", "vol_ratio_5_20"])
windowed("volume_ratios", CLEAN_FEATURES, "f2", ["volume_ma5_ratio", "volume_ma20_ratio", "volume_trend"])
ORACLE["range_ratio"] = select(CLEAN_FEATURES, f"""SELECT ticker, date,
    {r('high_ratio', 6, '"52w_high_ratio"')}, {r('low_ratio', 6, '"52w_low_ratio"')} FROM f2""")
windowed("bar_shape", CLEAN_FEATURES, "f2", ["close_to_high", "close_to_low", "high_low_range_pct", "gap_pct"])
ORACLE["ffwd_return_label"] = select(CLEAN_FEATURES, f"""SELECT ticker, date, {r('next_ret')},
    CASE WHEN next_ret > 0.01 THEN 1 WHEN next_ret IS NOT NULL THEN 0 END AS target FROM f2""")
windowed("noise_filter", CLEAN_FEATURES, "f2", ["close", "next_ret"], where="WHERE next_ret > 0.01 OR next_ret < -0.01")
ORACLE["circuit_flags"] = select(CHANGED, """SELECT ticker, date,
    CASE WHEN close / ldcp > 1.045 THEN 1 ELSE 0 END AS near_upper_circuit,
    CASE WHEN close / ldcp < 0.955 THEN 1 ELSE 0 END AS near_lower_circuit FROM changed""")
ORACLE["calendar"] = select(BARS, "SELECT ticker, date, isodow(date) - 1 AS day_of_week, month(date) AS month FROM bars")
DISTANCES = ", ".join(f"{clip_sql(f'close / nullif(ema_{s}, 0) - 1', -0.5, 0.5)} AS close_to_ema{s}" for s in (9, 21, 50))
ORACLE["ema_distance"] = select(INDICATORS, f"""SELECT ticker, date,
    {rs(['close_to_ema9', 'close_to_ema21', 'close_to_ema50'])} FROM (SELECT *, {DISTANCES} FROM ind)""")
BOUNDED = f"""{clip_sql('macd / nullif(close, 0)', -0.5, 0.5)} AS macd_n, {clip_sql('bb_pct', -0.5, 1.5)} AS bb_pct_n,
    {clip_sql('bb_width', 0, 1)} AS bb_width_n, {clip_sql('turbulence', 0, 20)} AS turbulence_n"""
ORACLE["macd_norm"] = select(SURVIVORS, f"""SELECT ticker, date, {r('macd_n', 6, 'macd')}, {r('bb_pct_n', 6, 'bb_pct')},
    {r('bb_width_n', 6, 'bb_width')}, {r('turbulence_n', 6, 'turbulence')} FROM (SELECT *, {BOUNDED} FROM surv)""")

# -- small labelled table -----------------------------------------------------------

LABELLED = CLEAN + f""",
lab0 AS (SELECT *, ln(lead(close, 5) OVER w / close) AS next_ret FROM clean {W}),
lab AS (
    SELECT ticker, date, close, volume, high - low AS span, CASE WHEN next_ret > 0.01 THEN 1 ELSE 0 END AS target
    FROM lab0 WHERE next_ret > 0.01 OR next_ret < -0.01
)"""
SPLIT = LABELLED + f""",
sp0 AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM lab {W}),
sp AS (
    SELECT *, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
                   WHEN rn <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM sp0
)"""
SMALL = ("close", "volume", "span")
STATE = SPLIT + ",\nstate AS (" + " UNION ALL ".join(
    f"SELECT ticker, '{c}' AS feature, avg({c}) AS mean, "
    f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS scale, max(date) AS train_end_date "
    f"FROM sp WHERE split = 'train' GROUP BY ticker" for c in SMALL
) + ")"
ORACLE["split_by_order"] = select(SPLIT, "SELECT ticker, date, split FROM sp")
ORACLE["scaler_fit"] = select(STATE, f"SELECT ticker, feature, {r('mean', 4)}, {r('scale', 4)}, train_end_date FROM state")
ORACLE["write_scaler_state"] = ORACLE["scaler_fit"]
ORACLE["scaler_apply"] = select(STATE, "SELECT sp.ticker, sp.date, sp.split, " + ", ".join(
    f"round((sp.{c} - s{i}.mean) / s{i}.scale, 5) + 0.0 AS {c}" for i, c in enumerate(SMALL)
) + ", sp.target FROM sp " + " ".join(
    f"JOIN state s{i} ON s{i}.ticker = sp.ticker AND s{i}.feature = '{c}'" for i, c in enumerate(SMALL)
))
ORACLE["train_end_date"] = select(SPLIT, "SELECT ticker, max(date) AS train_end_date FROM sp WHERE split = 'train' GROUP BY ticker")
ORACLE["class_weight"] = select(LABELLED, """SELECT ticker, count(*) FILTER (target = 1) AS n_pos,
    count(*) FILTER (target = 0) AS n_neg,
    round(count(*) FILTER (target = 0) / greatest(count(*) FILTER (target = 1), 1)::DOUBLE, 6) + 0.0 AS pos_weight
    FROM lab GROUP BY ticker""")
ORACLE["sequence_windows"] = select(SPLIT, """, seq AS (
    SELECT *, list(close::FLOAT) OVER s AS c, list(volume::FLOAT) OVER s AS v, list(span::FLOAT) OVER s AS p FROM sp
    WINDOW s AS (PARTITION BY ticker, split ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT ticker, date, split, 20 AS steps, 60 AS width, c[1]::DOUBLE AS first_value, p[20]::DOUBLE AS last_value,
    round(list_sum(list_transform(c, lambda x: x::DOUBLE)) + list_sum(list_transform(v, lambda x: x::DOUBLE))
        + list_sum(list_transform(p, lambda x: x::DOUBLE)), 2) AS total, target AS y
FROM seq WHERE len(c) = 20""")
ORACLE["sequence_windows"] = ORACLE["sequence_windows"].replace("\n, seq", ", seq")
ORACLE["target_balance"] = select(CLEAN_FEATURES, """SELECT count(*) FILTER (ok) AS n_rows, count(*) FILTER (NOT ok) AS dropped_rows,
    count(DISTINCT ticker) FILTER (ok) AS tickers, round(avg(t) FILTER (ok) * 100, 1) AS up_pct,
    round((1 - avg(t) FILTER (ok)) * 100, 1) AS down_pct
    FROM (SELECT *, ret_1d IS NOT NULL AND ret_20d IS NOT NULL AND next_ret IS NOT NULL AS ok,
          CASE WHEN next_ret > 0.01 THEN 1.0::DOUBLE ELSE 0.0 END AS t FROM f2)""")
ORACLE["null_report"] = select(CLEAN_FEATURES, " UNION ALL ".join(
    f'SELECT \'{c}\' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 1) AS null_pct FROM f2'
    for c in ("ldcp", "ret_1d", "ret_5d", "ret_10d", "ret_20d")
))
ORACLE["coverage_report"] = select(BARS, """SELECT count(*) AS n_rows, count(DISTINCT ticker) AS tickers,
    min(date) AS first_date, max(date) AS last_date FROM bars""")
ORACLE["trading_calendar"] = select(BARS, "SELECT DISTINCT date FROM bars")
ORACLE["broadcast_check"] = select(BARS, """SELECT date, round(min(high), 8) + 0.0 AS lowest, round(max(high), 8) + 0.0 AS highest
    FROM bars GROUP BY date HAVING count(DISTINCT high) > 1""")
ORACLE["parse_html_table"] = select(BARS, """SELECT ticker, date, round(open, 8) AS open, round(high, 8) AS high,
    round(low, 8) AS low, round(close, 8) AS close, round(volume, 0) AS volume FROM bars""")

# -- news ---------------------------------------------------------------------------

RAW = "[" + ", ".join(quoted(x) for x in roles.RAW_LABELS) + "]"
ARTICLES = f"""
articles AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, CAST(DATE '1996-01-01' + CAST((doc_id % 250) * 10 AS INTEGER) AS DATE) AS date,
           source, ({RAW})[doc_id % {len(roles.RAW_LABELS)} + 1] AS category, text AS title, lang AS description,
           'https://news.example.org/item/' || CAST(doc_id // 2 AS VARCHAR) AS url_key
    FROM documents
)"""
NOT_WORD = r"[^\p{L}\p{M}\p{N}_]"


def has_word(col: str, phrases) -> str:
    return f"regexp_matches({col}, {quoted(f'(?i)(?:^|{NOT_WORD})(?:' + '|'.join(phrases) + f')(?:$|{NOT_WORD})')})"


def has_pattern(col: str, patterns) -> str:
    return f"regexp_matches({col}, {quoted('|'.join(f'(?:{p})' for p in patterns))})"


def has_part(col: str, literals) -> str:
    return "(" + " OR ".join(f"contains({col}, {quoted(x)})" for x in literals) + ")"


H = roles.HEADLINES
ALL_WORDS = [p for ps in H.categories.values() for p in ps]
GATE = (
    f"length(title) >= 15 AND NOT {has_word('title', H.foreign)} AND NOT {has_word('title', H.excluded)} "
    f"AND {has_word('title', H.anchor)} AND {has_word('title', ALL_WORDS)}"
)
BOTH = "trim(title || ' ' || description)"
GATE_DESC = (
    f"length(title) >= 15 AND NOT {has_word(BOTH, H.foreign)} AND NOT {has_word(BOTH, H.excluded)} "
    f"AND category <> 'weather' AND {has_word(BOTH, ALL_WORDS)}"
)


def labels(col: str) -> str:
    found = ", ".join(f"CASE WHEN {has_word(col, ps)} THEN '{c}' END" for c, ps in H.categories.items())
    return f"coalesce(nullif(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), '|'), ''), '{H.default}')"


CATEGORY = "CASE split_part(lower(trim(category)), '|', 1) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in roles.CATEGORY_TABLE.items()
) + " END"
NORM = r"trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


def word_count(words) -> str:
    """Hits of whole words: every boundary character is doubled, so that neighbours share none."""
    doubled = f"regexp_replace(title, {quoted('(' + NOT_WORD + ')')}, '\\1\\1', 'g')"
    return f"len(regexp_extract_all({doubled}, {quoted(f'(?i)(?:^|{NOT_WORD})(?:' + '|'.join(words) + f')(?:$|{NOT_WORD})')}))"


SCORES = ARTICLES + f""",
logits AS (SELECT *, CAST({word_count(roles.POSITIVE)} AS DOUBLE) AS a, CAST({word_count(roles.NEGATIVE)} AS DOUBLE) AS b, 0.5::DOUBLE AS c FROM articles),
probs AS (SELECT *, greatest(a, b, c) AS top, 1.0 / (exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))) AS p FROM logits),
scored_all AS (
    SELECT *, CASE WHEN a = top THEN 'positive' WHEN b = top THEN 'negative' ELSE 'neutral' END AS sentiment_label,
           {even('p', 6)} AS sentiment_score,
           CASE WHEN a = top THEN {even('p', 6)} WHEN b = top THEN -{even('p', 6)} ELSE 0.0 END AS sentiment_compound
    FROM probs
),
scored AS (SELECT * REPLACE ({CATEGORY} AS category) FROM scored_all WHERE {CATEGORY} IS NOT NULL)"""
ORACLE["score_text"] = select(SCORES, f"SELECT id, sentiment_label, {rs(['sentiment_score', 'sentiment_compound'])} FROM scored_all")
ORACLE["score_text_model"] = ORACLE["score_text"]
ORACLE["logits_to_sentiment"] = """WITH l AS (
    SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
p AS (SELECT *, greatest(a, b, c) AS top FROM l),
q AS (SELECT *, """ + even('exp(top) / (exp(a) + exp(b) + exp(c))', 6) + """ AS s FROM p)
SELECT vec_id, CASE WHEN a = top THEN 'positive' WHEN b = top THEN 'negative' ELSE 'neutral' END AS sentiment_label,
    s + 0.0 AS sentiment_score, CASE WHEN a = top THEN s WHEN b = top THEN -s ELSE 0.0 END + 0.0 AS sentiment_compound FROM q"""

ORACLE["read_articles"] = select(ARTICLES, "SELECT id, source, date, title FROM articles WHERE source IS NOT NULL")
ORACLE["headline_gate"] = select(ARTICLES, f"SELECT id, title FROM articles WHERE {GATE}")
ORACLE["headline_gate_desc"] = select(ARTICLES, f"SELECT id, category FROM articles WHERE {GATE_DESC}")
R = roles.RELEVANCE
RELEVANT = f"""CASE WHEN {has_pattern('t', R.keep)} THEN 1 WHEN {has_pattern('t', R.off_topic)} THEN 0
    WHEN {has_pattern('t', R.price_ticker)} AND NOT {has_pattern('t', R.price_ticker_keep)} THEN 0
    WHEN {has_part('t', R.institutions)} THEN 1 WHEN {has_pattern('t', [R.amount])} THEN 1
    WHEN {has_part('t', R.country)} THEN 1 WHEN {has_pattern('t', R.foreign)} THEN 0 ELSE 1 END"""
ORACLE["relevance_cascade"] = select(ARTICLES, f"SELECT id, {RELEVANT} AS relevant FROM (SELECT *, lower(title) AS t FROM articles)")
ORACLE["multi_label"] = select(ARTICLES, f"SELECT id, {labels('title')} AS labels FROM articles")
ORACLE["primary_label"] = select(ARTICLES, f"SELECT id, split_part({labels('title')}, '|', 1) AS label FROM articles")
ORACLE["normalize_title"] = select(ARTICLES, f"SELECT id, {NORM} AS norm FROM articles")
ORACLE["map_category"] = select(ARTICLES, f"SELECT id, {CATEGORY} AS category FROM articles WHERE {CATEGORY} IS NOT NULL")
ORACLE["map_category_subcategory"] = select(ARTICLES, f"""SELECT id, {CATEGORY} AS category FROM (
    SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'Rates|macro' ELSE category END AS category) FROM articles)
    WHERE {CATEGORY} IS NOT NULL""")
ORACLE["seen_anti_join"] = select(ARTICLES, "SELECT id, source FROM articles WHERE doc_id NOT IN (SELECT doc_id FROM labels)")




def words_of(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), {quoted(NOT_WORD + '+')}), lambda w: w <> '')"


RULES = f"""said AS (SELECT {words_of('text')} AS w FROM conversations),
phrases AS (SELECT DISTINCT phrase FROM (
    SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM said WHERE len(w) > 1
    UNION ALL SELECT unnest(list_filter(w, lambda x: length(x) > 4)) FROM said)),
rules AS (SELECT phrase, CASE {' '.join(f"WHEN md5(phrase) < '{b}' THEN '{g}'" for b, g in roles.RULE_GATES)} ELSE 'category' END AS gate,
    CASE {' '.join(f"WHEN substr(md5(phrase), 3, 1) < '{b}' THEN '{n}'" for b, n in roles.RULE_LABELS)} ELSE 'corporate' END AS label,
    ascii(substr(md5(phrase), 4, 1)) AS priority FROM phrases),
spoken AS (SELECT id, doc_id, title, {words_of('title')} AS w FROM articles),
grams AS (SELECT DISTINCT doc_id, phrase FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM spoken WHERE len(w) > 1
    UNION ALL SELECT doc_id, unnest(w) FROM spoken)),
hits AS (SELECT doc_id, gate, label, min(priority) AS priority FROM grams JOIN rules USING (phrase) GROUP BY ALL),
flags AS (SELECT doc_id, list(DISTINCT gate) AS g FROM hits GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(label, '|' ORDER BY priority, label) AS labels FROM hits WHERE gate = 'category' GROUP BY doc_id)"""
HIT = "coalesce(list_contains(g, '{}'), false)".format
ORACLE["headline_gate_table"] = select(ARTICLES + ", " + RULES, f"""SELECT id, labels FROM articles JOIN flags USING (doc_id) JOIN named USING (doc_id)
    WHERE length(title) >= 15 AND NOT {HIT('foreign')} AND NOT {HIT('excluded')} AND {HIT('anchor')}""")
ORACLE["relevance_cascade_table"] = select(ARTICLES + ", " + RULES, f"""SELECT id, CASE WHEN {HIT('keep')} THEN 1 WHEN {HIT('off_topic')} THEN 0
    WHEN {HIT('price_ticker')} AND NOT {HIT('price_ticker_keep')} THEN 0 WHEN {HIT('institution')} THEN 1
    WHEN coalesce(regexp_matches(lower(title), 'rs[0-9]'), false) THEN 1 WHEN {HIT('country')} THEN 1 WHEN {HIT('foreign_signal')} THEN 0 ELSE 1 END AS relevant
    FROM articles LEFT JOIN flags USING (doc_id)""")
DELIVERY = "CASE WHEN day(date) <= 10 THEN 1 WHEN day(date) <= 20 THEN 2 ELSE 3 END"
ORACLE["seen_ledger"] = select(ARTICLES, f"""SELECT id, batch FROM (
    SELECT id, doc_id, {DELIVERY} AS batch, nullif({NORM.replace('title', "coalesce(title, '')")}, '') AS key FROM articles)
    QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY batch, doc_id) = 1""")
ORACLE["seen_ledger_batches"] = select(ARTICLES, f"SELECT {DELIVERY} AS batch, count(DISTINCT id) AS n_keys FROM articles GROUP BY 1")
ORACLE["stream_new_keys"] = """SELECT min(event_id) AS event_id, event_type, strftime(ts, '%Y-%m-%d %H') AS hour FROM events GROUP BY event_type, hour"""


def first_rows(source: str, keys: str, order: str) -> str:
    return f"SELECT * EXCLUDE (rn_) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn_ FROM {source}) WHERE rn_ = 1"


ORACLE["dedup_bars"] = f"""SELECT date, ticker, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM ({first_rows(
    '(SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem)',
    'date, ticker', 'l_orderkey, l_linenumber, l_partkey, l_extendedprice')})"""
URL_TITLE = ARTICLES + f""",
u1 AS ({first_rows('articles', 'url_key', 'doc_id')}),
u2 AS ({first_rows('u1', 'date, title', 'doc_id')})"""
ORACLE["dedup_url_title"] = select(URL_TITLE, "SELECT id, url_key AS url FROM u2")
ORACLE["url_feed"] = select(URL_TITLE, f"SELECT id, {labels('title')} AS category FROM u2 WHERE {GATE}")
ORACLE["dedup_date_title"] = select(ARTICLES, f"""SELECT id, {labels('title')} AS category FROM (
    {first_rows(f'(SELECT * FROM articles WHERE {GATE})', 'date, title', 'doc_id')})""")
ORACLE["dedup_id_title"] = select(ARTICLES + f""",
t0 AS (SELECT * REPLACE (CAST(doc_id * 2 // 3 AS VARCHAR) AS id) FROM articles),
t1 AS ({first_rows('t0', 'id', 'doc_id')}),
t2 AS ({first_rows('t1', 'lower(trim(title))', 'doc_id')})""", "SELECT id, doc_id FROM t2")
ORACLE["id_feed"] = select(ARTICLES + f""",
t2 AS ({first_rows('articles', 'lower(trim(title))', 'doc_id')})""",
    f"SELECT id, {labels(BOTH)} AS subcategory FROM t2 WHERE {GATE_DESC}")
PRIORITY = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in roles.PRIORITY.items()) + " ELSE 99 END"
ORACLE["dedup_cross_source"] = select(ARTICLES, "SELECT id, date, source FROM (" + first_rows(
    f"(SELECT *, {NORM} AS norm FROM articles)", "norm", f"date, {PRIORITY}, source, doc_id") + ")")
ORACLE["merged_news"] = select(ARTICLES + f""",
m0 AS (SELECT *, {NORM} AS norm FROM (SELECT * REPLACE ({CATEGORY} AS category) FROM articles
       WHERE source IS NOT NULL AND {CATEGORY} IS NOT NULL)),
m1 AS ({first_rows('m0', 'norm', f'date, {PRIORITY}, source, title')})""",
    f"SELECT date, source, category, title FROM (SELECT *, lower(title) AS t FROM m1) WHERE {RELEVANT} = 1")
ORACLE["text_scalars"] = select(ARTICLES, """SELECT id, url_key AS url_key,
    'https://News.example.org/item/' || CAST(doc_id // 2 AS VARCHAR) AS url, upper(trim(category)) AS upper_label,
    split_part(lower(trim(category)), '|', 1) AS first_label, length(title) AS n_chars,
    len(string_split(category, '|')) AS n_labels FROM articles""")
ORACLE["union_sources"] = """SELECT CAST(doc_id AS VARCHAR) AS id, source, text AS title FROM documents
    UNION ALL SELECT CAST(item_id AS VARCHAR), NULL, text FROM benchmark"""
ORACLE["parse_json_items"] = select(ARTICLES, """SELECT id, CAST(date AS VARCHAR) AS date, source AS category, title,
    substr(title, 1, 300) AS description,
    'https://feed.example.org/' || CASE WHEN doc_id % 3 = 0 THEN 'n-' ELSE '-' END || id AS url FROM articles""")
ORACLE["parse_event_props"] = "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events"

CATEGORIES = ("macro", "energy", "banking", "forex", "corporate")
DAILY = SCORES + f""",
daily AS (SELECT date, category, {even('avg(sentiment_compound)', 6)} AS sentiment FROM scored GROUP BY date, category)"""
NUMBERED_TITLES = f"""SELECT date, category, title, row_number() OVER (PARTITION BY date, category ORDER BY norm, doc_id) AS rn
    FROM (SELECT *, {NORM} AS norm FROM scored)"""
ORACLE["daily_titles"] = select(SCORES, f"SELECT date, category, rn AS rank, title FROM ({NUMBERED_TITLES})")
ORACLE["daily_title_cells"] = select(SCORES, f"""SELECT date, category, CAST((rn - 1) // 3 AS INTEGER) AS part,
    string_agg(title, ' | ' ORDER BY rn) AS title FROM ({NUMBERED_TITLES}) GROUP BY ALL""")
ORACLE["daily_sentiment_pivot"] = select(DAILY, f"""SELECT date, category, {', '.join(
    f"CASE WHEN category = '{c}' THEN sentiment ELSE 0.0 END + 0.0 AS sentiment_{c}" for c in CATEGORIES)} FROM daily""")
LAGGED = DAILY + """,
lagged AS (SELECT * FROM (
    SELECT date, category, lag(sentiment) OVER (PARTITION BY category ORDER BY date) AS sentiment FROM daily)
    WHERE sentiment IS NOT NULL)"""
ORACLE["sentiment_lag"] = select(LAGGED, f"SELECT date, category, {r('sentiment')} FROM lagged")
ORACLE["sentiment_reports"] = select(SCORES, """SELECT 'label' AS report, sentiment_label AS value, count(*) AS n_rows,
    count(DISTINCT date) AS dates, round(avg(sentiment_compound), 4) AS mean_compound FROM scored GROUP BY 2
    UNION ALL SELECT 'category', category, count(*), count(DISTINCT date), round(avg(sentiment_compound), 4) FROM scored GROUP BY 2
    UNION ALL SELECT 'all', NULL, count(*), count(DISTINCT date), round(avg(sentiment_compound), 4) FROM scored""")

# -- prices and news ----------------------------------------------------------------

TICKERS = "CASE ticker " + " ".join(
    f"WHEN '{t}' THEN '{c}'" for c, ts in roles.TICKER_CATEGORIES.items() for t in ts
) + " ELSE 'unassigned' END"
DIMENSION = "(SELECT p_brand AS ticker, min(p_type) AS category FROM part GROUP BY p_brand HAVING 2 * sum(p_size) >= 51 * count(*))"
ORACLE["ticker_category"] = select(BARS, f"SELECT ticker, date, {TICKERS} AS category FROM bars")
ORACLE["ticker_category_table"] = select(BARS, f"""SELECT bars.ticker, date, coalesce(category, 'unassigned') AS category
    FROM bars LEFT JOIN {DIMENSION} d ON d.ticker = bars.ticker""")
ORACLE["unassigned_tickers"] = f"""SELECT DISTINCT upper(p_brand) AS ticker FROM part JOIN lineitem ON l_partkey = p_partkey
    WHERE p_brand NOT IN (SELECT ticker FROM {DIMENSION})"""
ORACLE["category_summary"] = select(BARS, f"""SELECT {TICKERS} AS category, count(*) AS n_rows, count(DISTINCT ticker) AS tickers
    FROM bars GROUP BY 1""")
ORACLE["write_partitioned"] = select(BARS, f"SELECT ticker, date, {r('close', 8)}, {TICKERS} AS category FROM bars")
MERGED = CLEAN + "," + LAGGED + f""",
priced AS (SELECT *, {TICKERS} AS category FROM clean),
served AS (SELECT * FROM priced WHERE category <> 'unassigned'),
days AS (SELECT DISTINCT category, date FROM served),
filled AS (
    SELECT d.category, d.date, coalesce(last_value(l.sentiment IGNORE NULLS) OVER (
        PARTITION BY d.category ORDER BY d.date ROWS UNBOUNDED PRECEDING), 0.0) AS sentiment
    FROM days d LEFT JOIN lagged l ON l.category = d.category AND l.date = d.date
),
merged AS (SELECT s.*, f.sentiment FROM served s JOIN filled f USING (category, date))"""
ORACLE["price_sentiment_join"] = select(MERGED, f"SELECT ticker, date, category, {rs(['close', 'sentiment'])} FROM merged")
ORACLE["category_view"] = select(MERGED, f"""SELECT ticker, date, {r('close', 8)}, {r('sentiment', 6, 'sentiment_macro')}
    FROM merged WHERE category = 'macro'""")
ORACLE["merge_summary"] = select(MERGED, """SELECT category, count(*) AS n_rows, count(*) FILTER (sentiment <> 0) AS nonzero,
    round(100.0::DOUBLE * count(*) FILTER (sentiment <> 0) / count(*), 1) AS nonzero_pct FROM merged GROUP BY category""")
ORACLE["ffill_by_date"] = select(CLEAN + "," + DAILY + f""",
days AS (SELECT DISTINCT {TICKERS} AS category, date FROM clean)""", """SELECT category, date,
    round(coalesce(last_value(sentiment IGNORE NULLS) OVER (PARTITION BY category ORDER BY date ROWS UNBOUNDED PRECEDING), 0.0), 6) + 0.0 AS sentiment
    FROM days LEFT JOIN daily USING (category, date)""")

NEWS = SCORES + f""",
cat_news AS (SELECT category, date, avg(sentiment_compound) AS sentiment_relevant, count(*) AS news_count FROM scored GROUP BY ALL),
mention AS (""" + " UNION ALL ".join(
    f"SELECT {quoted(w)} AS word, {quoted(t)} AS ticker" for w, t in roles.MENTIONS.items()
) + f"""),
words AS (SELECT DISTINCT doc_id, date, sentiment_compound, word FROM (
    SELECT doc_id, date, sentiment_compound, unnest(string_split_regex(lower(title), {quoted(NOT_WORD + '+')})) AS word FROM scored)),
tick_news AS (SELECT ticker, date, avg(sentiment_compound) AS sentiment_ticker FROM (
    SELECT DISTINCT ticker, doc_id, date, sentiment_compound FROM words JOIN mention USING (word)) GROUP BY ALL)"""


def flags_of(source: str) -> str:
    return f""",
flags AS (
    SELECT k.ticker, k.date, coalesce(sentiment_relevant, 0.0) AS sentiment_relevant,
           coalesce(sentiment_ticker, 0.0) AS sentiment_ticker, coalesce(news_count, 0) AS news_count
    FROM (SELECT ticker, date, {TICKERS} AS category FROM {source}) k
    LEFT JOIN cat_news c ON c.category = k.category AND c.date = k.date
    LEFT JOIN tick_news t ON t.ticker = k.ticker AND t.date = k.date
)"""


def decay_of(source: str) -> str:
    decay = "exp(-ln(2.0::DOUBLE) / 3.7::DOUBLE * (k.date - {a}.date))"
    return f""",
decayed AS (
    SELECT k.ticker, k.date, coalesce(c.sentiment_relevant * {decay.format(a='c')}, 0.0) AS sentiment_relevant,
           coalesce(t.sentiment_ticker * {decay.format(a='t')}, 0.0) AS sentiment_ticker,
           coalesce(s.news_count, 0) AS news_count
    FROM (SELECT ticker, date, {TICKERS} AS category FROM {source}) k
    ASOF LEFT JOIN cat_news c ON c.category = k.category AND c.date <= k.date
    ASOF LEFT JOIN tick_news t ON t.ticker = k.ticker AND t.date <= k.date
    LEFT JOIN cat_news s ON s.category = k.category AND s.date = k.date
)"""


NEWS_OUT = f"ticker, date, {r('sentiment_relevant', 10)}, {r('sentiment_ticker', 10)}, news_count"
ORACLE["news_features_join"] = select(CLEAN + "," + NEWS + flags_of("clean"), f"SELECT {NEWS_OUT} FROM flags")
ORACLE["news_decay_join"] = select(CLEAN + "," + NEWS + decay_of("clean"), f"SELECT {NEWS_OUT} FROM decayed")

MATRIX = SURVIVORS + features_over("surv") + f""",
f3 AS (
    SELECT *, {DISTANCES}, {BOUNDED}, CASE WHEN next_ret > 0.01 THEN 1 ELSE 0 END AS target FROM f2
    WHERE next_ret > 0.01 OR next_ret < -0.01
),
"""
FEATURES = (
    "ret_1d", "ret_5d", "ret_10d", "ret_20d", "rsi", "macd_n", "bb_pct_n", "bb_width_n", "turbulence_n",
    "close_to_ema9", "close_to_ema21", "close_to_ema50", "close_to_high", "close_to_low", "gap_pct", "high_low_range_pct",
    "volume_ma5_ratio", "volume_ma20_ratio", "vol_ratio_5_20", "rolling_vol_10", "rolling_vol_20", "volume_trend",
    "high_ratio", "low_ratio", "near_upper_circuit", "near_lower_circuit", "day_of_week", "month",
)
NAMES = {
    "macd_n": "macd", "bb_pct_n": "bb_pct", "bb_width_n": "bb_width", "turbulence_n": "turbulence",
    "high_ratio": '"52w_high_ratio"', "low_ratio": '"52w_low_ratio"',
}
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
ORACLE["feature_matrix"] = select(MATRIX + NEWS.strip() + flags_of("bars"), f"""SELECT f3.ticker, f3.date, round(f3.close, 8) + 0.0 AS close,
    {', '.join(f'round(CAST({c} AS DOUBLE), 4) + 0.0 AS {NAMES.get(c, c)}' for c in FEATURES)},
    {', '.join(f'round(CAST({c} AS DOUBLE), 10) + 0.0 AS {c}' for c in ('sentiment_relevant', 'sentiment_ticker', 'news_count'))}, target
    FROM f3 JOIN flags USING (ticker, date) WHERE {COMPLETE}""")
ORACLE["feature_matrix_decay"] = select(MATRIX + NEWS.strip() + decay_of("bars"), f"""SELECT f3.ticker, f3.date,
    {', '.join(f'round(CAST({c} AS DOUBLE), 10) + 0.0 AS {c}' for c in ('sentiment_relevant', 'sentiment_ticker', 'news_count'))}, target
    FROM f3 JOIN decayed USING (ticker, date) WHERE {COMPLETE}""")

# -- pages, work lists, announcements -----------------------------------------------

ORACLE["extract_links"] = r"""WITH origin AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site,
        unnest(regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
        unnest(regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 2)) AS link FROM pages),
links AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN site || href ELSE href END AS href,
    trim(replace(replace(replace(replace(regexp_replace(link, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title FROM origin)
SELECT page_id, regexp_replace(split_part(href, '?', 1), '/+$', '') AS url, title FROM links
WHERE regexp_matches(href, 'example\.(?:com|org|net)/([^/?#]+)') AND length(title) >= 10
    AND regexp_extract(href, 'example\.(?:com|org|net)/([^/?#]+)', 1) NOT IN ('laleenéelle', 'about')"""
ORACLE["extract_links_hidden"] = ORACLE["extract_links"]
ORACLE["month_worklist"] = """SELECT symbol, year(m)::INTEGER AS year, month(m)::INTEGER AS month FROM (SELECT DISTINCT p_brand AS symbol FROM part),
    (SELECT unnest(generate_series(DATE '2010-01-01', DATE '2011-03-01', INTERVAL 1 MONTH)) AS m)"""
ORACLE["date_worklist"] = """SELECT symbol, CAST(d AS DATE) AS date FROM (SELECT DISTINCT p_brand AS symbol FROM part),
    (SELECT unnest(generate_series(DATE '2024-02-27', DATE '2024-03-02', INTERVAL 1 DAY)) AS d)"""
ORACLE["type_worklist"] = """SELECT symbol, type FROM (SELECT DISTINCT p_brand AS symbol FROM part), (VALUES ('C'), ('D')) t(type)
    UNION ALL SELECT '', 'E'"""
ORACLE["coverage_gaps"] = select(BARS, """SELECT symbol, date FROM (
    SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT ticker AS symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY ticker)) w
    WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.ticker = w.symbol AND b.date = w.date)""")
RANGES = BARS + """,
spans AS (SELECT DISTINCT p_brand AS symbol FROM part),
gaps AS (SELECT symbol, day FROM (SELECT symbol, CAST(unnest(generate_series(DATE '1995-01-01', DATE '1999-12-31', INTERVAL 1 DAY)) AS DATE) AS day FROM spans)
    WHERE (symbol, day) NOT IN (SELECT (ticker, date) FROM bars))"""
ORACLE["coverage_ranges"] = select(RANGES, """SELECT symbol, min(day) AS "from", max(day) AS "to", CAST(count(*) AS INTEGER) AS days
    FROM (SELECT *, day - CAST(row_number() OVER (PARTITION BY symbol ORDER BY day) AS INTEGER) AS run FROM gaps) GROUP BY symbol, run""")
ORACLE["coverage_months"] = select(RANGES, """SELECT symbol, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, count(*) AS days
    FROM gaps GROUP BY ALL""")
ORACLE["covered_ranges"] = select(BARS, """SELECT ticker AS symbol, min(date) AS "from", max(date) AS "to", count(*) AS days FROM (
    SELECT ticker, date, sum(starts) OVER (PARTITION BY ticker ORDER BY date) AS run FROM (
        SELECT ticker, date, CASE WHEN date - lag(date) OVER (PARTITION BY ticker ORDER BY date) <= 3 THEN 0 ELSE 1 END AS starts FROM bars))
    GROUP BY ticker, run""")
ORACLE["bucketed_changes"] = select(CHANGED, f"SELECT ticker, date, {rs(('close', 'ldcp'), 8)}, {rs(('change', 'change_pct'), 2)} FROM changed")
SCALED = STATE + ",\nsc AS (SELECT sp.ticker, sp.date, sp.split, sp.target, " + ", ".join(
    f"(sp.{c} - s{i}.mean) / s{i}.scale AS {c}" for i, c in enumerate(SMALL)
) + " FROM sp " + " ".join(f"JOIN state s{i} ON s{i}.ticker = sp.ticker AND s{i}.feature = '{c}'" for i, c in enumerate(SMALL)) + """),
po AS (SELECT ticker, date, split, target AS y, count(*) OVER b AS n, """ + ", ".join(
    [f"avg({c}) OVER b AS mean_{c}" for c in SMALL] + [f"lag({c}) OVER s AS last_{c}" for c in SMALL]
) + """ FROM sc WINDOW s AS (PARTITION BY ticker, split ORDER BY date), b AS (PARTITION BY ticker, split ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
)"""
POOLED = tuple(f"mean_{c}" for c in SMALL) + tuple(f"last_{c}" for c in SMALL)
ORACLE["pooled_samples"] = select(SCALED, f"SELECT ticker, date, split, {rs(POOLED, 5)}, y FROM po WHERE n = 20")
ORACLE["score_with_coefficients"] = select(SCALED + """,
co AS (SELECT ticker, avg(y) - 0.5 AS base, """ + ", ".join(
    f"coalesce(avg({c}) FILTER (y = 1) - avg({c}) FILTER (y = 0), 0.0) AS w_{c}" for c in POOLED
) + " FROM po WHERE n = 20 AND split = 'train' GROUP BY ticker)", "SELECT po.ticker, date, split, round(1 / (1 + exp(-(base + "
    + " + ".join(f"{c} * w_{c}" for c in POOLED) + "))), 6) + 0.0 AS prob_up FROM po LEFT JOIN co ON co.ticker = po.ticker WHERE n = 20")
ORACLE["symbol_clean"] = r"""SELECT c_custkey, regexp_replace(upper(trim('  ' || lower(c_name) ||
    ['.ka ', '.PK', '.KA.KA', ''][c_custkey % 4 + 1])), '[.](KA|PK)$', '') AS symbol FROM customer"""
A = roles.ANNOUNCEMENTS
ANNOUNCED = """
ann AS (SELECT conv_id, turn, role AS symbol, text AS title, 'T' || CAST(turn % 3 AS VARCHAR) AS type,
    CAST(DATE '2019-11-01' + CAST(conv_id % 900 AS INTEGER) AS DATE) AS day FROM conversations)"""
BARE = (
    f"(len(list_filter(string_split_regex(trim(x), '\\s+'), lambda y: y <> '')) <= 7 AND "
    f"regexp_matches(x, {quoted(f'(?i)(?:^|{NOT_WORD})(?:' + '|'.join(A.company_suffixes) + ')' + chr(92) + 's*(?:Limited)?' + chr(92) + 's*$')}) "
    f"AND NOT {has_word('x', A.keywords)})"
)
JUNK = (
    f"(upper(x) IN ({', '.join(quoted(j) for j in A.junk)}) OR regexp_matches(x, {quoted('(?i)' + A.time)}))"
)
ORACLE["announcement_clean"] = select(ANNOUNCED, f"""SELECT conv_id, turn, title FROM (SELECT *, trim(title) AS x FROM ann)
    WHERE NOT {JUNK} AND NOT {BARE} AND length(x) >= 8""")
ORACLE["parse_announcement_rows"] = select(ANNOUNCED + f""",
cells AS (SELECT *, 'Company ' || symbol || ' Limited' AS c1, trim(title) AS c2 FROM ann WHERE year(day) BETWEEN 2020 AND 2021),
long AS (SELECT conv_id, turn, day, 1 AS place, c1 AS x FROM cells UNION ALL SELECT conv_id, turn, day, 2, c2 FROM cells),
named AS (SELECT * FROM long WHERE length(x) >= 6 AND NOT {JUNK} AND NOT {BARE})""",
    """SELECT conv_id, turn, strftime(day, '%b %d, %Y') AS date, x AS title FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(x) DESC, place) AS rn FROM named) WHERE rn = 1""")
ORACLE["dedup_announcements"] = select(ANNOUNCED + """,
short AS (SELECT * REPLACE (split_part(title, ' ', 1) AS title) FROM ann)""",
    f"""SELECT strftime(day, '%b %d, %Y') AS date, symbol, title, type, conv_id, turn
    FROM ({first_rows('short', 'day, symbol, title', 'type, conv_id, turn')})""")
ORACLE["announcement_reports"] = select(ANNOUNCED, """SELECT 'year' AS report, CAST(year(day) AS VARCHAR) AS value, count(*) AS n FROM ann GROUP BY 2
    UNION ALL SELECT 'type', type, count(*) FROM ann GROUP BY 2 UNION ALL SELECT 'symbol', symbol, count(*) FROM ann GROUP BY 2""")
ORACLE["sorts"] = select(ANNOUNCED, "SELECT symbol, strftime(day, '%b %d, %Y') AS date, conv_id, turn FROM ann ORDER BY symbol, day DESC")
ORACLE["preview"] = select(ANNOUNCED, """SELECT symbol, strftime(day, '%b %d, %Y') AS date, conv_id, turn FROM ann
    ORDER BY symbol, day DESC, conv_id, turn LIMIT 20""")
ORACLE["date_scalars"] = select(ANNOUNCED, """SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN day END AS parsed,
    CASE WHEN turn % 3 <> 0 THEN CAST(year(day) AS INTEGER) END AS year,
    CASE WHEN turn % 3 <> 0 THEN strftime(day, '%Y-%m-%d') END AS iso FROM ann""")
ORACLE["label_smoothing"] = "SELECT doc_id, round(quality * (1 - 0.15::DOUBLE) + 0.5 * 0.15::DOUBLE, 6) AS smoothed FROM labels"
ORACLE["clip"] = "SELECT event_id, CASE WHEN value <> 1.0 THEN least(greatest(value, 2.0), 9.5) END AS value FROM events"

# -- metrics ------------------------------------------------------------------------

PREDICTED = """
pred AS (SELECT lang AS ticker, CASE WHEN doc_id % 3 = 0 THEN 'val' ELSE 'test' END AS split, quality AS actual,
    (n_chars % 500) / 500.0::DOUBLE AS prob_up, (n_chars % 37) / 10.0::DOUBLE - 1.8 AS logit
    FROM labels JOIN documents USING (doc_id))"""
PAIRS = """(SELECT p.ticker, p.split, sum(CASE WHEN p.prob_up > n.prob_up THEN 1.0 WHEN p.prob_up = n.prob_up THEN 0.5 ELSE 0.0 END)::DOUBLE
    / count(*) AS auc FROM pred p JOIN pred n ON p.ticker = n.ticker AND p.split = n.split
    WHERE p.actual = 1 AND n.actual = 0 GROUP BY ALL)"""
F1 = """coalesce(2.0::DOUBLE * count(*) FILTER (prob_up >= 0.5 AND actual = 1)
        / nullif(count(*) FILTER (prob_up >= 0.5) + count(*) FILTER (actual = 1), 0), 0)"""
ACC = f"""(SELECT ticker, split, count(*) AS n, {even('count(*) FILTER ((prob_up >= 0.5) = (actual = 1)) / count(*)::DOUBLE', 4)} AS acc,
    {even(F1, 4)} AS f1
    FROM pred GROUP BY ALL)"""
ORACLE["auc"] = select(PREDICTED, f"SELECT a.ticker, a.split, {r('auc')} FROM {ACC} a LEFT JOIN {PAIRS} USING (ticker, split)")
ORACLE["acc_f1"] = select(PREDICTED, f"SELECT * FROM {ACC}")
ORACLE["metrics_summary"] = select(PREDICTED, f"""SELECT a.ticker, a.split, n, acc, {even('auc', 4)} AS auc, f1
    FROM {ACC} a LEFT JOIN {PAIRS} USING (ticker, split)""")
ORACLE["mae_rmse"] = select(PREDICTED, """SELECT ticker, round(avg(abs(prob_up - actual)), 6) + 0.0 AS mae,
    round(sqrt(avg((prob_up - actual) * (prob_up - actual))), 6) + 0.0 AS rmse FROM pred GROUP BY ticker""")
ORACLE["directional_accuracy"] = select(PREDICTED, """SELECT ticker,
    round(avg(CASE WHEN (prob_up >= 0.5) = (actual = 1) THEN 1.0::DOUBLE ELSE 0.0 END) * 100, 4) + 0.0 AS directional_acc_pct
    FROM pred GROUP BY ticker""")
ORACLE["r2"] = select(PREDICTED, """SELECT ticker, round(1 - sum((actual - prob_up) * (actual - prob_up))
    / (sum((actual - m) * (actual - m)) + 1e-8), 6) + 0.0 AS r2
    FROM (SELECT *, avg(actual) OVER (PARTITION BY ticker) AS m FROM pred) GROUP BY ticker""")
ORACLE["residuals"] = select(PREDICTED, """SELECT ticker, round(sum(prob_up - actual), 4) AS total,
    round(max(prob_up - actual), 6) AS largest FROM pred GROUP BY ticker""")
ORACLE["weighted_logloss"] = select(PREDICTED, """SELECT ticker, split,
    round(avg(-(0.25 * y * ln(1 / (1 + exp(-logit))) + (1 - y) * ln(1 - 1 / (1 + exp(-logit))))), 6) + 0.0 AS loss
    FROM (SELECT *, actual * (1 - 0.15::DOUBLE) + 0.5 * 0.15::DOUBLE AS y FROM pred) GROUP BY ticker, split""")
HISTORY = """
hist AS (SELECT event_type AS run, event_id AS epoch, value AS val_loss, (event_id * 37 % 1009) / 1009.0::DOUBLE AS val_auc FROM events)"""
ORACLE["best_epoch"] = select(HISTORY, """SELECT run, arg_min(epoch, row(val_loss, epoch)) AS best_epoch,
    round(min(val_loss), 6) + 0.0 AS best_val_loss, round(max(val_auc), 6) + 0.0 AS best_val_auc FROM hist GROUP BY run""")
ORACLE["early_stop"] = select(HISTORY + """,
h1 AS (SELECT *, row_number() OVER w AS pos, val_auc > coalesce(max(val_auc) OVER (PARTITION BY run ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS improved FROM hist WINDOW w AS (PARTITION BY run ORDER BY epoch)),
h2 AS (SELECT *, pos - coalesce(max(CASE WHEN improved THEN pos END) OVER (PARTITION BY run ORDER BY epoch), 0) AS waited FROM h1),
h3 AS (SELECT run, min(pos) FILTER (waited >= 40) AS stop FROM h2 GROUP BY run)""",
    """SELECT run, arg_max(epoch, pos) FILTER (improved) AS best_epoch, round(max(val_auc) FILTER (improved), 6) + 0.0 AS best_val_auc,
    max(epoch) FILTER (pos = stop) AS stop_epoch, count(*) AS epochs_run
    FROM h2 JOIN h3 USING (run) WHERE pos <= coalesce(stop, 9223372036854775807) GROUP BY run""")

ORACLE["running_scan"] = """SELECT event_id, round(max(value) OVER w, 6) + 0.0 AS top, round(min(value) OVER b, 6) + 0.0 AS low_before,
    CAST(sum(user_id) OVER w AS BIGINT) AS users, last_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER b AS last_large,
    first_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER w AS first_large FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           b AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
ORACLE["ffill_intraday"] = """SELECT event_type, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS ts, round(coalesce(last_value(level IGNORE NULLS) OVER (
    PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0), 6) + 0.0 AS level
    FROM (SELECT event_type, ts, max(value) FILTER (value > 50) AS level FROM events GROUP BY event_type, ts)"""

# -- intraday and streams -----------------------------------------------------------

INTRADAY = f"""
clean AS (SELECT event_type AS ticker, row(ts, event_id) AS date, event_id, value AS close, value AS high, value AS low FROM events),
i0 AS (SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS delta, (high + low + close) / 3 AS tp,
    lead(close, 5) OVER w AS later FROM clean {W}),
i1 AS (SELECT *, CASE WHEN delta > 0 THEN delta WHEN delta <= 0 THEN 0.0 END AS gain,
    CASE WHEN delta < 0 THEN -delta WHEN delta >= 0 THEN 0.0 END AS loss FROM i0),
i2 AS (SELECT *, {full('avg', 'gain', 14)} AS gains, {full('avg', 'loss', 14)} AS losses, {full('avg', 'tp', 20)} AS tp_mean,
    list(tp) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tps,
    {full('avg', 'close', 20)} AS bb_mid, {full('stddev_pop', 'close', 20)} AS sd, {ema_sql(9)} AS ema_9, {ema_sql(50)} AS ema_50 FROM i1)"""
ORACLE["intraday_positions"] = """SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position,
    count(*) OVER (PARTITION BY event_type) AS size FROM events"""
ORACLE["intraday_split"] = """SELECT event_id, event_type AS ticker, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN rn <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn,
          count(*) OVER (PARTITION BY event_type) AS n FROM events)"""
ORACLE["intraday_indicators"] = select(INTRADAY, """SELECT ticker, event_id,
    round(100 - 100 / (1 + gains / nullif(losses, 0)), 4) + 0.0 AS rsi,
    round((tp - tp_mean) / (0.015 * nullif(list_avg(list_transform(tps, lambda x: abs(x - tp_mean))), 0)), 4) + 0.0 AS cci,
    round(bb_mid, 4) + 0.0 AS bb_mid, round(nullif(4 * sd, 0) / nullif(bb_mid, 0), 4) + 0.0 AS bb_width,
    round(ema_9, 4) + 0.0 AS ema_9, round(ema_50, 4) + 0.0 AS ema_50,
    round(CASE WHEN later > 0 AND close > 0 THEN ln(later / close) WHEN close > 0 AND later = 0 THEN '-infinity'::DOUBLE
          WHEN close = 0 AND later > 0 THEN 'infinity'::DOUBLE END, 4) + 0.0 AS next_ret FROM i2""")
HOURLY = """
bars AS (
    SELECT event_type AS ticker, date_trunc('hour', ts) AS date, arg_min(value + 1, row(ts, event_id)) AS open, max(value + 1) AS high,
           min(value + 1) AS low, arg_max(value + 1, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume
    FROM events GROUP BY ALL
)"""
HOURLY_MATRIX = MATRIX.replace(BARS, HOURLY).rstrip().rstrip(",") + f""",
ready AS (SELECT * FROM f3 WHERE {COMPLETE}),
cut AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY ticker) AS n FROM ready {W}),
hours AS (SELECT *, CAST(epoch(date) AS BIGINT) AS instant, CASE WHEN nth <= floor(n * 0.7::DOUBLE) THEN 'train'
    WHEN nth <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM cut)"""
ORACLE["intraday_feature_matrix"] = select(HOURLY_MATRIX, f"""SELECT ticker AS symbol, instant, round(close, 8) + 0.0 AS close,
    {', '.join(f'round(CAST({c} AS DOUBLE), 4) + 0.0 AS {NAMES.get(c, c)}' for c in FEATURES)}, target, split FROM hours""")
ORACLE["intraday_sequences"] = select(HOURLY_MATRIX, """SELECT ticker AS symbol, instant, split,
    round(list_sum(list_transform(x, lambda v: v::DOUBLE)), 1) AS total, target::FLOAT AS y
    FROM (SELECT *, list(rsi::FLOAT) OVER (PARTITION BY ticker, split ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS x FROM hours)
    WHERE len(x) = 20""")
ORACLE["stream_first_seen"] = "SELECT event_id, event_type FROM events"
ORACLE["stream_daily_sentiment"] = """SELECT CAST(ts AS DATE) AS date, event_type AS category, round(avg(value), 6) + 0.0 AS mean_value, count(*) AS n
    FROM events GROUP BY ALL"""
ORACLE["stream_headline_gate"] = f"""SELECT doc_id, {labels('title')} AS labels FROM (SELECT doc_id, text AS title FROM documents) WHERE {GATE}"""
ORACLE["stream_ohlc"] = """SELECT CAST(ts AS DATE) AS date, event_type AS ticker, round(arg_min(value, row(ts, event_id)), 6) + 0.0 AS open,
    round(max(value), 6) + 0.0 AS high, round(min(value), 6) + 0.0 AS low,
    round(arg_max(value, row(ts, event_id)), 6) + 0.0 AS close, round(sum(1.0::DOUBLE), 6) + 0.0 AS volume
    FROM events GROUP BY ALL"""
ORACLE["stream_corrected_sentiment"] = ORACLE["stream_daily_sentiment"]
ORACLE["stream_corrected_ohlc"] = ORACLE["stream_ohlc"]
