"""Column expressions that parse and normalise raw fields. All stay inside code generation."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoplane.keys import as_tuple, in_days

# Date formats tried in turn; the home marker, opponent and team patterns of an event label.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM d, yyyy", "M/d/yyyy")
HOME_PATTERN = r"vs\."
OPPONENT_PATTERN = r"(vs\.|@)\s+([A-Z]{3})"
TEAM_PATTERN = r"([A-Z]{3})"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c) -> Column:
    """Double, or NULL where the text is no number."""
    return col(c).try_cast("double")


def parse_duration(c) -> Column:
    """`"32:30"` is 32.5; a number is itself; NULL or anything else is 0."""
    text = col(c).cast("string")
    parts = F.split(text, ":")
    minutes = F.try_element_at(parts, F.lit(1)).try_cast("double")
    seconds = F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.coalesce(
        F.when(text.contains(":"), minutes + seconds / 60).otherwise(text.try_cast("double")), F.lit(0.0)
    )


def to_date_coerce(c, formats=DATE_FORMATS) -> Column:
    """First format that fits, else NULL."""
    text = col(c).cast("string")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def pct_to_fraction(c) -> Column:
    """`"25.3%"` is 0.253."""
    return F.regexp_replace(col(c).cast("string"), "%", "").try_cast("double") / 100


def home_flag(label) -> Column:
    return F.coalesce(col(label).rlike(HOME_PATTERN), F.lit(False)).cast("int")


def opponent_of(label) -> Column:
    return F.nullif(F.regexp_extract(col(label), OPPONENT_PATTERN, 2), F.lit(""))


def team_of(label) -> Column:
    return F.nullif(F.regexp_extract(col(label), TEAM_PATTERN, 1), F.lit(""))


def first_token(label) -> Column:
    return F.split(col(label), " ")[0]


def name_standardise(c, mapping: dict[str, str] | None = None, before_comma: bool = False) -> Column:
    """Trim, keep the part before a comma if asked, then map fixed spellings."""
    name = F.trim(col(c))
    if before_comma:
        name = F.trim(F.split(name, ",")[0])
    if not mapping:
        return name
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, name), name)


def season_label(date, first_month: int = 10) -> Column:
    """`2023-24` for dates from October 2023 to September 2024."""
    d = col(date)
    start = F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1)
    return F.format_string("%d-%02d", start, F.pmod(start + 1, F.lit(100)))


def season_id_decode(season_id) -> Column:
    """`22024` is `2024-25`; a code that does not hold a year is NULL."""
    year = F.substring(col(season_id).cast("string"), 2, 10).try_cast("int")
    return F.when(year.isNotNull(), F.format_string("%d-%02d", year, F.pmod(year + 1, F.lit(100))))


def season_lookup(label) -> Column:
    """Label of the season before, worked out from the label itself, so any season has one."""
    year = F.substring(col(label), 1, 4).try_cast("int")
    return F.when(year.isNotNull(), F.format_string("%d-%02d", year - 1, F.pmod(year, F.lit(100))))


def safe_divide(x, y, fill: float | None = 0.0) -> Column:
    q = col(x) / F.nullif(col(y), F.lit(0))
    return q if fill is None else F.coalesce(q, F.lit(fill))


def z_score(x, mean, std) -> Column:
    return (col(x) - col(mean)) / F.nullif(col(std), F.lit(0))


def clip(c, low=None, high=None) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def calendar_features(df: DataFrame, date: str) -> DataFrame:
    """Month, season stage, day of week (Monday 0) and weekend (Friday to Sunday)."""
    d = F.col(date)
    month, dow = F.month(d), F.weekday(d)
    # Months of the season stages.
    stages = {
        "is_early_season": (10, 11),
        "is_mid_season": (12, 1, 2),
        "is_late_season": (3, 4),
        "is_playoff_month": (5, 6),
    }
    return df.withColumns(
        {
            "game_month": month,
            **{n: month.isin(*m).cast("int") for n, m in stages.items()},
            "day_of_week": dow,
            "is_weekend": dow.isin(4, 5, 6).cast("int"),
        }
    )


def standardise_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by map and keep only the mapped columns that are present."""
    return df.select([F.col(f"`{old}`").alias(new) for old, new in mapping.items() if old in df.columns])


def base_projection(df: DataFrame, grain, extra=()) -> DataFrame:
    """Key columns, plus target, season and name columns when they are present."""
    return df.select(*as_tuple(grain), *[c for c in as_tuple(extra) if c in df.columns])


def sum_target(df: DataFrame, parts, name: str) -> DataFrame:
    """Target as the sum of its parts; an existing column is kept."""
    return df if name in df.columns else df.withColumn(name, reduce(add, [F.col(p) for p in parts]))


def project_or_null(df: DataFrame, keys, mapping: dict[str, str]) -> DataFrame:
    """Key columns and new name <- source column, NULL doubles where the source is absent."""
    return df.select(
        *as_tuple(keys),
        *[
            (F.col(f"`{src}`") if src in df.columns else F.lit(None)).cast("double").alias(new)
            for new, src in mapping.items()
        ],
    )


# Projected reference columns.
USAGE_COLUMNS = {
    "usage_rate": "usage",
    "usage_rate_rank": "usage_rank",
    "points_per_shot_attempt": "psa",
    "psa_rank": "psa_rank",
}
PLAYMAKING_COLUMNS = {
    "assist_rate": "ast%",
    "assist_rate_rank": "ast%_rank",
    "ast_to_usage_ratio": "ast:usg",
    "turnover_rate": "tov%",
    "turnover_rate_rank": "tov%_rank",
}


def usage_projection(df: DataFrame, keys) -> DataFrame:
    return project_or_null(df, keys, USAGE_COLUMNS)


def playmaking_projection(df: DataFrame, keys) -> DataFrame:
    return project_or_null(df, keys, PLAYMAKING_COLUMNS)


# Weights of the linear scores, the bar a statistic must reach to count as double.
SCORE_WEIGHTS = {
    "fantasy": {"pts": 1, "reb": 1.2, "ast": 1.5, "stl": 3, "blk": 3, "tov": -1},
    "dk": {"pts": 1, "reb": 1.25, "ast": 1.5, "stl": 2, "blk": 2, "tov": -0.5},
    "fd": {"pts": 1, "reb": 1.2, "ast": 1.5, "stl": 3, "blk": 3, "tov": -1},
}
DK_DOUBLE_BONUS, DK_TRIPLE_BONUS, DOUBLE_BAR = 1.5, 3.0, 10


def linear_score(weights: dict[str, float], columns: dict[str, str] | None = None) -> Column:
    names = columns or {}
    return reduce(add, [F.col(names.get(k, k)) * w for k, w in weights.items()])


def threshold_count(stats, bar: float = DOUBLE_BAR) -> Column:
    """How many of the statistics reach the bar."""
    return reduce(add, [F.when(col(c) >= bar, 1).otherwise(0) for c in stats])


def weighted_scores(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Linear scores; the second one has a bonus for two and for three statistics at ten or more."""
    names = columns or {}
    reached = threshold_count([names.get(k, k) for k in ("pts", "reb", "ast", "stl", "blk")])
    bonus = F.when(reached >= 2, DK_DOUBLE_BONUS).otherwise(0.0) + F.when(reached >= 3, DK_TRIPLE_BONUS).otherwise(0.0)
    return df.withColumns(
        {
            "double_double": reached >= 2,
            "triple_double": reached >= 3,
            "fantasy_score": linear_score(SCORE_WEIGHTS["fantasy"], columns),
            "dk_score": linear_score(SCORE_WEIGHTS["dk"], columns) + bonus,
            "fd_score": linear_score(SCORE_WEIGHTS["fd"], columns),
        }
    )


def ratio_features(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Shooting, rebounding and per-36 ratios of the same row (report form; lag them before use as features)."""
    names = columns or {}

    def c(k: str) -> Column:
        return F.col(names.get(k, k))

    def over(x: Column, y: Column) -> Column:
        return x / F.nullif(y.cast("double"), F.lit(0.0))

    # Half a made shot per three, 0.44 possessions per free throw, 36 minutes.
    return df.withColumns(
        {
            "efg_pct": over(c("fgm") + 0.5 * c("fg3m"), c("fga")),
            "true_shooting_pct": over(c("pts"), 2 * (c("fga") + 0.44 * c("fta"))),
            "offensive_rebound_pct": over(c("oreb"), c("reb")),
            "defensive_rebound_pct": over(c("dreb"), c("reb")),
            "defensive_stocks": c("stl") + c("blk"),
            "steals_per_36": over(c("stl"), c("minutes")) * 36,
            "blocks_per_36": over(c("blk"), c("minutes")) * 36,
        }
    )


# Role thresholds.
HIGH_USAGE, LOW_USAGE, PLAYMAKER_RATE, THREE_POINT_RATE = 0.25, 0.18, 0.25, 0.50


def role_flags(df: DataFrame, usage: str, assist_rate: str, threes: str, shots: str) -> DataFrame:
    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False)).cast("int")

    rate = F.col(threes) / F.nullif(F.col(shots).cast("double"), F.lit(0.0))
    return df.withColumns(
        {
            "is_high_usage": flag(F.col(usage) >= HIGH_USAGE),
            "is_low_usage": flag(F.col(usage) < LOW_USAGE),
            "is_primary_playmaker": flag(F.col(assist_rate) >= PLAYMAKER_RATE),
            "is_three_point_specialist": flag(rate >= THREE_POINT_RATE),
        }
    )


def player_filter(df: DataFrame, career: str = "career_games", recent: str = "recent_games",
                  min_career: int = 5, min_recent: int = 3) -> DataFrame:
    """Entities with enough history; a rule whose column is absent does not apply. The defaults."""
    for name, least in ((career, min_career), (recent, min_recent)):
        if name in df.columns:
            df = df.filter(F.col(name) >= least)
    return df


def select_features(df: DataFrame, target: str | None, exclude=(), stored=None) -> list[str]:
    """Names of the numeric feature columns: all but the excluded, or the stored list when scoring."""
    if stored is not None:
        missing = [c for c in stored if c not in df.columns]
        if missing:
            raise ValueError(f"features absent: {missing}")
        return list(stored)
    drop = {*as_tuple(exclude), target}
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    return [n for n, t in df.dtypes if n not in drop and (t in numeric or t.startswith("decimal"))]


def feature_matrix(df: DataFrame, target: str, features, keys=(), fill: float | None = None) -> DataFrame:
    """Keys, features as doubles and target. A NULL target or an infinite value fails the job that reads it."""
    inf = [F.lit(float("inf")), F.lit(float("-inf"))]

    def checked(name: str) -> Column:
        c = F.col(name).cast("double")
        c = F.when(c.isin(*inf), F.raise_error(F.lit(f"infinite value in {name}")).cast("double")).otherwise(c)
        return (F.coalesce(c, F.lit(fill)) if fill is not None else c).alias(name)

    y = F.col(target).cast("double")
    y = F.when(y.isNull(), F.raise_error(F.lit(f"NULL target {target}")).cast("double")).otherwise(y)
    return df.select(*as_tuple(keys), *[checked(f) for f in features], y.alias(target))


def upcoming_filter(df: DataFrame, ts: str, date=None, now: Column | None = None) -> DataFrame:
    """Events on a date, or starting after `now` (default: the current time)."""
    if date is not None:
        day = dt.date.fromisoformat(str(date))
        return in_days(df, ts, day, day + dt.timedelta(days=1))
    return df.filter(F.col(ts) > (F.current_timestamp() if now is None else now))
