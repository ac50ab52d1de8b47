"""Queries of clustering, similarity, recommendation and targeting."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import clustering as c
from ..operators import hierarchy, segments, vector_index
from ..operators import similarity as s
from ..sources.shared import folder, written
from . import views as v
from .registry import query

_COLUMNS = ["bet_amount", "session_duration", "games_played"]
_LONG = ", e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from embeddings), c as (select label, d, avg(x) as m, count(*) as n from e group by 1, 2)"
_LABELLED = ", l as (" + " union all ".join(f"select cast(user_id % 4 as int) - 1 as label, '{x}' as feature, {x}::double as x from bets" for x in _COLUMNS) + ")"


def _labelled(spark, sf):
    return v.bets(spark, sf).withColumn("label", (F.col("user_id") % 4 - 1).cast("int"))


@query("with " + _LONG[2:] + """, p as (select e.label, vec_id, sum((x - m) * (x - m)) as d2 from e join c on c.label = e.label and c.d = e.d group by 1, 2), s as (select label, avg(sqrt(d2)) as s, sum(d2) as w, count(*) as n from p group by label),
pair as (select a.label a, b.label b, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d from c a join c b on a.d = b.d and a.label <> b.label group by 1, 2), r as (select pair.a, max((x.s + y.s) / pair.d) as r from pair join s x on x.label = pair.a join s y on y.label = pair.b group by pair.a),
mu as (select d, avg(x) as m from e group by d), b as (select sum(c.n * (c.m - mu.m) * (c.m - mu.m)) as b from c join mu on mu.d = c.d)
select (select avg(r) from r) as davies_bouldin, (select b from b) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))) as calinski_harabasz, count(*) as clusters from s""", (), "davies_bouldin calinski_harabasz")
def internal_metrics(spark, sf):
    return c.internal_metrics(v.vectors(spark, sf), "embedding")


@query("with " + _LONG[2:] + """, p as (select vec_id, sqrt(sum((x - m) * (x - m))) as d from e join c on c.label = e.label and c.d = e.d group by 1), q as (select a.label, b.label, sqrt(sum((a.m - b.m) * (a.m - b.m))) as d from c a join c b on a.d = b.d and a.label < b.label group by 1, 2)
select (select avg(d) from p) as compactness, avg(d) as separation, avg(d) / (select avg(d) from p) as ratio from q""", (), "compactness separation ratio")
def compactness_separation(spark, sf):
    return c.compactness_separation(v.vectors(spark, sf), "embedding")


@query("""with t as (select label as a, cast(vec_id % 7 as int) as b from embeddings), n as (select a, b, count(*)::double n from t group by 1, 2), ra as (select a, sum(n) r from n group by 1), cb as (select b, sum(n) c from n group by 1), z as (select sum(n) t, sum(n * (n - 1) / 2) ij from n),
pa as (select sum(r * (r - 1) / 2) p, -sum(r / t * ln(r / t)) h from ra, z), pb as (select sum(c * (c - 1) / 2) p, -sum(c / t * ln(c / t)) h from cb, z), mi as (select sum(n / t * ln(n * t / (r * c))) mi from n join ra using (a) join cb using (b), z)
select (ij - pa.p * pb.p / (t * (t - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (t * (t - 1) / 2)) as ari, mi / ((pa.h + pb.h) / 2) as nmi, mi / pa.h as homogeneity, mi / pb.h as completeness, 2 * (mi / pa.h) * (mi / pb.h) / (mi / pa.h + mi / pb.h) as v_measure from z, pa, pb, mi""", (), "ari nmi homogeneity completeness v_measure")
def external_metrics(spark, sf):
    return c.external_metrics(v.vectors(spark, sf).withColumn("other", (F.col("vec_id") % 7).cast("int")), "label", "other")


@query(_LABELLED + """, z as (select count(*) t from bets), n as (select cast(user_id % 4 as int) - 1 as label, count(*) size from bets group by 1)
select l.label, feature, any_value(size) as size, any_value(size) * 100 / any_value(t) as percentage, avg(x) as mean, median(x) as median, stddev_samp(x) as std, min(x) as min, max(x) as max, l.label = -1 as is_noise from l join n on n.label = l.label, z group by l.label, feature""", (v.BETS,), "percentage mean median std min max")
def cluster_profiles(spark, sf):
    return c.cluster_profiles(_labelled(spark, sf), _COLUMNS)


@query(_LABELLED + ", m as (select feature, label, avg(x) m from l group by 1, 2), b as (select feature, var_pop(m) b from m group by 1) select l.feature, any_value(b) / var_pop(x) as importance from l join b on b.feature = l.feature group by l.feature", (v.BETS,), "importance")
def cluster_importance(spark, sf):
    return c.cluster_importance(_labelled(spark, sf), _COLUMNS)


@query(_LABELLED + """, g as (select feature, label, count(x) n, avg(x) m, var_pop(x) * count(x) w from l group by 1, 2), t as (select feature, avg(x) mu from l group by 1), q as (select g.feature, sum(n * (m - mu) * (m - mu)) b, sum(w) w, sum(n) n, count(*) k from g join t on t.feature = g.feature group by 1)
select feature, (b / (k - 1)) / (w / (n - k)) as f, b / (b + w) as eta_squared from q""", (v.BETS,), "f eta_squared")
def business_separation(spark, sf):
    return c.business_separation(_labelled(spark, sf), _COLUMNS)


@query(_LABELLED + """, o as (select feature, avg(x) filter (where label <> -1) a, avg(x) filter (where label = -1) b, var_samp(x) filter (where label <> -1) v0, var_samp(x) filter (where label = -1) v1 from l group by 1)
select feature, a as inside, b as outside, b - a as difference, (b - a) / sqrt((v0 + v1) / 2) as effect from o""", (v.BETS,), "inside outside difference effect")
def outlier_analysis(spark, sf):
    return c.outlier_analysis(_labelled(spark, sf), _COLUMNS)


@query(""", l as (select cast(games_played as int) as label, 'bet_amount' as feature, bet_amount as x from bets union all select cast(games_played as int), 'games_played', games_played::double from bets), t as (select feature, avg(x) mu, stddev_samp(x) sd from l group by 1), m as (select label, feature, avg(x) m from l group by 1, 2)
select label, m.feature, (m - mu) / sd as deviation from m join t on t.feature = m.feature where abs((m - mu) / sd) > 1""", (v.BETS,), "deviation")
def differentiators(spark, sf):
    return c.differentiators(v.bets(spark, sf).withColumn("label", F.col("games_played").cast("int")), ["bet_amount", "games_played"])


@query(""", p as (select user_id, avg(bet_amount) * 1.2::double as avg_bet, count(*) / 80.0::double as frequency, stddev_samp(bet_amount) / avg(bet_amount) as volatility, avg(promotion_used) as response_rate from bets group by 1)
select user_id, case when avg_bet > 100 then case when volatility > 1.5 then 'High Roller Risk Taker' else 'VIP Conservative Player' end when avg_bet > 50 then case when frequency > 0.7 then 'Regular Engaged Player' else 'Moderate Occasional Player' end when frequency > 0.8 then 'Frequent Small Bettor' when response_rate > 0.3 then 'Promotion-Responsive Player' when volatility < 0.5 then 'Cautious Conservative Player' else 'Casual Gaming Enthusiast' end as archetype from p""", (v.BETS,))
def archetype(spark, sf):
    p = v.bets(spark, sf).groupBy("user_id").agg((F.avg("bet_amount") * 1.2).alias("avg_bet"), (F.count("*") / 80.0).alias("frequency"), (F.stddev_samp("bet_amount") / F.avg("bet_amount")).alias("volatility"), F.avg("promotion_used").alias("response_rate"))
    return c.archetype(p).select("user_id", "archetype")


@query(""", p as (select games_played, count(*)::double size, sum(bet_amount) as value, avg(promotion_used) as risk from bets group by 1), t as (select sum(value) v, sum(size) s from p)
select 1 - stddev_samp(size) / avg(size) as balance, sum((value / v) * (value / v)) as value_concentration, sum(risk * size / s) as weighted_risk from p, t""", (v.BETS,), "balance value_concentration weighted_risk")
def cross_cluster(spark, sf):
    p = v.bets(spark, sf).groupBy("games_played").agg(F.count("*").cast("double").alias("size"), F.sum("bet_amount").alias("value"), F.avg("promotion_used").alias("risk"))
    return c.cross_cluster(p)


@query()
def kmeans(spark, sf):
    return c.kmeans(v.vectors(spark, sf).drop("label"), 10, "embedding")[1].select("vec_id", "label", "distance", "confidence")


@query()
def kmeans_auto(spark, sf):
    """The measures of each k, and which was chosen."""
    k, table = c.kmeans_auto(v.vectors(spark, sf).drop("label"), range(3, 7), "embedding")
    return table.withColumn("chosen", F.col("k") == k)


def _matrix(spark, sf):
    users = v.bets(spark, sf).groupBy("user_id").agg(F.avg("bet_amount").alias("a"), F.count("*").alias("n"), F.avg("session_duration").alias("d"))
    return c.prepare_matrix(written(users, "matrix-users"), "user_id", ["a", "n", "d"])


@query(""", u as (select user_id, avg(bet_amount) a, count(*)::double n, avg(session_duration) d from bets group by 1), t as (select avg(a) ma, stddev_pop(a) sa, avg(n) mn, stddev_pop(n) sn, avg(d) md, stddev_pop(d) sd from u)
select user_id, (a - ma) / sa as f0, (n - mn) / sn as f1, (d - md) / sd as f2 from u, t""", (v.BETS,), "f0 f1 f2")
def prepare_matrix(spark, sf):
    return _matrix(spark, sf).select("user_id", *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


@query()
def project_2d(spark, sf):
    return c.project_2d(v.vectors(spark, sf), "embedding").select("vec_id", *[F.col("projected")[i].alias(f"p{i}") for i in range(2)])


@query()
def dbscan(spark, sf):
    return hierarchy.dbscan(_matrix(spark, sf), "user_id", "features", 0.9, 4, 3)


@query(""", l as (select user_id, cast(user_id % 4 as int) a, cast(user_id % 4 as int) b, cast(user_id % 3 as int) x from bets group by user_id), t as (select x, a, count(*) n from l group by 1, 2), m as (select x, a as y, row_number() over (partition by x order by n desc, a) k from t),
w as (select user_id, a as label, 1.0::double / 3 w from l union all select user_id, b, 1.0::double / 3 from l union all select user_id, m.y, 1.0::double / 3 from l join m on m.x = l.x and m.k = 1), g as (select user_id, label, sum(w) w from w group by 1, 2), r as (select *, row_number() over (partition by user_id order by w desc, label) k from g)
select user_id, case when w >= 0.6 then label else -1 end as label, w as agreement from r where k = 1""", (v.BETS,), "agreement")
def ensemble_vote(spark, sf):
    users = v.bets(spark, sf).select("user_id").distinct()
    of = lambda n: users.select("user_id", (F.col("user_id") % n).cast("int").alias("label"))
    return c.ensemble_vote([of(4), of(4), of(3)], [1.0, 1.0, 1.0], "user_id")


@query()
def ensemble_stability(spark, sf):
    return c.ensemble_stability(ensemble_vote(spark, sf))


_PAIRS = ", p as (select a.vec_id as a, b.vec_id as b, a.embedding::double[64] as x, b.embedding::double[64] as y from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


@query("with " + _PAIRS[2:] + """, q as (select a, b, unnest(x) as x, unnest(y) as y from p)
select a, b, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) as cosine, 1 / (1 + sqrt(sum((x - y) * (x - y)))) as euclidean, (corr(x, y) + 1) / 2 as pearson from q group by 1, 2""", (), "cosine euclidean pearson")
def vector_similarity(spark, sf):
    a = v.vectors(spark, sf).select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = v.vectors(spark, sf).select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select("a", "b", *[s.vector_similarity(F.col("x"), F.col("y"), k).alias(k) for k in ("cosine", "euclidean", "pearson")])


@query("""with p as (select a.vec_id q, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select q as query_id, rank, vec_id, score from (select *, row_number() over (partition by q order by score desc, vec_id) as rank from p) where rank <= 5""", (), "score")
def knn(spark, sf):
    vectors = v.vectors(spark, sf)
    return s.knn(vectors.where("vec_id % 50 = 0"), vectors, 5).select("query_id", "rank", "vec_id", "score")


@query("""with p as (select a.vec_id q, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0 and b.label in (2, 5))
select q as query_id, rank, vec_id, score from (select *, row_number() over (partition by q order by score desc, vec_id) as rank from p) where rank <= 3""", (), "score")
def knn_filtered(spark, sf):
    vectors = v.vectors(spark, sf)
    return s.knn(vectors.where("vec_id % 100 = 0"), vectors, 3, where="label in (2, 5)").select("query_id", "rank", "vec_id", "score")


@query("select vec_id, vec_id % 11 <> 0 as fits from embeddings")
def split_dimension(spark, sf):
    rows = v.vectors(spark, sf).withColumn("embedding", F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 5)).otherwise(F.col("embedding")))
    good, bad = s.split_dimension(rows, 64)
    return good.select("vec_id", F.lit(True).alias("fits")).unionByName(bad.select("vec_id", F.lit(False).alias("fits")))


@query()
def reduce_vectors(spark, sf):
    return c.project_2d(v.vectors(spark, sf), "embedding", 8).select("vec_id", "projected")


@query("select vec_id, label from (select *, row_number() over (partition by label order by vec_id) n from embeddings where label in (1, 3)) where n <= 5")
def cluster_members(spark, sf):
    return segments.top_k_per(v.vectors(spark, sf).where("label in (1, 3)"), "label", [F.col("vec_id")], 5).select("vec_id", "label")


@query("select count(*) as vectors, min(len(embedding)) as least_dimension, max(len(embedding)) as most_dimension, count(distinct label) as labels from embeddings")
def vector_stats(spark, sf):
    return s.vector_stats(v.vectors(spark, sf)).withColumns({x: F.col(x).cast("long") for x in ("least_dimension", "most_dimension")})


@query("select vec_id, case when vec_id % 3 = 0 then -1 else label end as label from embeddings union all select vec_id + 1000000, -1 from embeddings where vec_id % 3 = 0")
def upsert_vectors(spark, sf):
    rows = v.vectors(spark, sf).select("vec_id", "label")
    third = rows.where("vec_id % 3 = 0").withColumn("label", F.lit(-1))
    return s.upsert(rows, third.unionByName(third.withColumn("vec_id", F.col("vec_id") + 1000000)), "vec_id")


@query("select vec_id, label from embeddings where label <> 4")
def delete_vectors(spark, sf):
    rows = v.vectors(spark, sf).select("vec_id", "label")
    return s.delete_keys(rows, rows.where("label = 4"), "vec_id")


@query(""", u as (select id as user_id, bet_count as h from users), w as (select id as user_id, case when id % 3 = 0 then bet_count + 1 else bet_count end as h, last_activity as t from users where id % 4 <> 0)
select u.user_id, case when w.t is null then 'missing' when u.h <> w.h then 'changed' else 'stale' end as reason from u left join w on w.user_id = u.user_id where w.t is null or u.h <> w.h or w.t < timestamp '2001-08-02' - interval 90 days""", (v.USERS,))
def needs_refresh(spark, sf):
    users = v.users(spark, sf)
    have = users.where("id % 4 <> 0").select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, F.col("bet_count") + 1).otherwise(F.col("bet_count")).alias("feature_hash"), F.col("last_activity").alias("updated_at"))
    return s.needs_refresh(users.select(F.col("id").alias("user_id"), F.col("bet_count").alias("feature_hash")), have, v.ORDERS_AS_OF, 90)


def _profiles(spark, sf):
    b = v.bets(spark, sf)
    return b.groupBy("user_id").agg(
        F.count("*").cast("double").alias("session_frequency"), F.countDistinct("game_type").cast("double").alias("game_diversity"), F.avg((F.col("win_amount") > 0).cast("double")).alias("win_rate"),
        F.avg("promotion_used").alias("risk_tolerance"), F.avg("session_duration").alias("session_duration"), F.avg("bet_amount").alias("avg_bet"), F.sum("bet_amount").alias("lifetime_value"),
        F.coalesce(F.sum("deposit_amount"), F.lit(0.0)).alias("total_deposits"), F.array_sort(F.collect_set(F.when(F.col("promotion_used") == 1, F.col("game_type")))).alias("favorite_games"),
        F.collect_set("game_type").alias("game_categories"), F.collect_set(F.when(F.col("promotion_used") == 1, F.hour("timestamp"))).alias("peak_hours"))


_NUMBERS = ["avg_bet", "session_frequency", "win_rate", "game_diversity", "risk_tolerance", "total_deposits", "lifetime_value", "session_duration"]
_PROFILES = """, pr as (select user_id, count(*)::double session_frequency, count(distinct game_type)::double game_diversity, avg(case when win_amount > 0 then 1.0 else 0.0 end) win_rate, avg(promotion_used) risk_tolerance, avg(session_duration) session_duration, avg(bet_amount) avg_bet, sum(bet_amount) lifetime_value,
coalesce(sum(deposit_amount), 0) total_deposits, list_sort(list(distinct game_type) filter (where promotion_used = 1)) favorite_games, list(distinct game_type) as game_categories, list(distinct hour(timestamp)) filter (where promotion_used = 1) as peak_hours from bets group by user_id),
st as (select """ + ", ".join(f"avg({x}) m_{x}, stddev_pop({x}) s_{x}" for x in _NUMBERS) + """ from pr), pv as (select user_id, [""" + ", ".join(f"0.4 * case when s_{x} > 0 then ({x} - m_{x}) / s_{x} else 0 end" if x in _NUMBERS else "0" for x in s.NUMERIC) + ", " + ", ".join(
    ["0"] * 9 + [f"0.3 * cast(list_contains(game_categories, '{x}') as int)" for x in s.CATEGORIES]) + ", " + ", ".join(f"0.2 * coalesce(cast(list_contains(peak_hours, {h}) as int), 0)" for h in range(24)) + ", 0, 0, 0, 0, 0, 0, 0]::double[] as x from pr, st), pn as (select user_id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) as embedding from pv)"


@query(_PROFILES + ", z as (select user_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as d from pn) select user_id, cast(d as int) as dimension, x as value from z where x <> 0", (v.BETS,), "value")
def profile_vectors(spark, sf):
    rows = s.profile_vectors(_profiles(spark, sf))
    return rows.select("user_id", F.posexplode("embedding").alias("dimension", "value")).where("value <> 0").withColumn("dimension", (F.col("dimension") + 1).cast("int"))


@query()
def profile_vectors_with_text(spark, sf):
    return s.profile_vectors(_profiles(spark, sf), text_dimensions=64)


@query(_PROFILES + """ select user_id, 'Gaming profile: ' || concat_ws(', ', case when avg_bet > 100 then 'high roller' when avg_bet > 50 then 'medium spender' else 'casual player' end, case when session_frequency > 10 then 'frequent player' when session_frequency > 3 then 'regular player' else 'occasional player' end,
case when win_rate > 0.6 then 'successful gambler' when win_rate > 0.4 then 'average performer' else 'unlucky player' end, case when len(favorite_games) > 0 then 'prefers ' || array_to_string(favorite_games[1:3], ', ') end, case when risk_tolerance > 0.7 then 'high risk tolerance' when risk_tolerance > 0.3 then 'moderate risk tolerance' else 'conservative player' end, 'new customer') as description from pr""", (v.BETS,))
def profile_text(spark, sf):
    return s.profile_text(_profiles(spark, sf)).select("user_id", "description")


def _sql_near(c, log=False):
    a, b = (f"ln(1 + {x}.{c})" if log else f"{x}.{c}" for x in "xy")
    return f"(1 - abs({a} - {b}) / greatest({a} + {b}, 1))"


_SIMILAR = _PROFILES + f""", cs as (select a.user_id as q, b.user_id as o, round(list_cosine_similarity(a.embedding, b.embedding), 9) as vector from pn a join pn b on a.user_id <> b.user_id where a.user_id % 100 = 0), nn as (select * from (select *, row_number() over (partition by q order by vector desc, o) as k from cs) where k <= 30),
q as (select x.user_id as user_id_1, y.user_id as user_id_2, vector, ({_sql_near('session_frequency')} + {_sql_near('game_diversity')} + 1 - abs(x.win_rate - y.win_rate) + 1 - abs(x.risk_tolerance - y.risk_tolerance) + {_sql_near('session_duration')}) / 5 as behavioral,
({_sql_near('avg_bet', True)} + {_sql_near('lifetime_value', True)} + {_sql_near('total_deposits', True)}) / 3 as financial, coalesce(len(list_intersect(x.favorite_games, y.favorite_games)), 0) as shared_games, 1 - abs(x.risk_tolerance - y.risk_tolerance) as risk_match,
x.avg_bet as b1, y.avg_bet as b2, x.win_rate as w1, y.win_rate as w2, y.session_frequency as f2, list_sort(list_intersect(x.favorite_games, y.favorite_games)) as mutual from nn join pr x on x.user_id = q join pr y on y.user_id = o),
r as (select *, vector * 0.6::double + behavioral * 0.25::double + financial * 0.15::double as score from q), bo as (select *, least(1, score * case when shared_games > 2 then 1.1 else 1 end::double * case when behavioral > 0.85 then 1.05 else 1 end::double * case when risk_match > 0.9 then 1.03 else 1 end::double) as boosted from r),
best as (select * from (select *, row_number() over (partition by user_id_1 order by round(boosted, 9) desc, user_id_2) as rank from bo) where rank <= 10)"""


_SIMILAR_ALL = _SIMILAR.replace(" where a.user_id % 100 = 0", "")


def _similar(spark, sf, which: str = "true"):
    profiles = written(_profiles(spark, sf), "profiles")
    return s.similar_users(profiles, s.profile_vectors(profiles), profiles.where(which), 10)


@query(_SIMILAR + """ select user_id_1, user_id_2, vector, behavioral, financial, cast(shared_games as int) as shared_games, score, boosted, case when score >= 0.85 then 'high' when score >= 0.7 then 'medium' else 'low' end as category, rank from best""", (v.BETS,), "vector behavioral financial score boosted")
def user_similarity(spark, sf):
    return _similar(spark, sf, "user_id % 100 = 0").select("user_id_1", "user_id_2", "vector", "behavioral", "financial", "shared_games", "score", "boosted", "category", "rank")


@query(_SIMILAR_ALL + """ select user_id_1, user_id_2, concat_ws('; ', case when vector > 0.8 then 'Strong overall similarity in gaming behavior' end, case when behavioral > 0.8 then 'Similar session patterns and game preferences' end, case when financial > 0.8 then 'Comparable spending and betting patterns' end, case when abs(b1 - b2) < 50 then 'Similar bet amounts' end, case when abs(w1 - w2) < 0.1 then 'Similar win rates' end, case when shared_games > 0 then 'Both enjoy ' || array_to_string(mutual[1:2], ', ') end) as reasons,
concat_ws('; ', case when b2 > 100 then 'High Roller VIP Program' end, case when f2 > 10 then 'Frequent Player Rewards' end, case when score > 0.8 then 'Friend Referral Program' end) as campaigns from best""", (v.BETS,))
def similarity_reasons(spark, sf):
    """Of all users."""
    return s.similarity_reasons(_similar(spark, sf)).select("user_id_1", "user_id_2", F.array_join("reasons", "; ").alias("reasons"), F.array_join("campaigns", "; ").alias("campaigns"))


@query(", n as (select game_id, count(distinct user_id) p from ratings group by 1) select game_id, p / (select max(p) from n) as score from n order by score desc, game_id limit 10", (v.RATINGS,), "score")
def recommend_popular(spark, sf):
    return s.recommend_popular(v.ratings(spark, sf))


_NEAR = ", uv as (select id, [" + ", ".join(f"({x} - avg({x}) over ()) / stddev_pop({x}) over ()" for x in ("total_bets", "bet_count", "win_rate", "balance")) + """]::double[] as x from users), nc as (select a.id as user_id, b.id as other, round(list_cosine_similarity(a.x, b.x), 9) as weight from uv a join uv b on a.id <> b.id where a.id % 100 = 0 or a.id < 10), nb as (select * from (select *, row_number() over (partition by user_id order by weight desc, other) as k from nc) where k <= 5)"""


_NEAR_ALL = _NEAR.replace(" where a.id % 100 = 0 or a.id < 10", "")


def _neighbours(spark, sf, which: str | None = None):
    """The five nearest of all users for all users, or for a stated set of them."""
    m = c.prepare_matrix(v.users(spark, sf), "id", ["total_bets", "bet_count", "win_rate", "balance"]).select(F.col("id").alias("vec_id"), F.col("features").alias("embedding"))
    near = s.knn(m.where(which), m, 5) if which else hierarchy.cosine_neighbours(m, 5)
    return near.select(F.col("query_id").alias("user_id"), F.col("vec_id").alias("other"), F.col("score").alias("weight"))


@query(_NEAR + """, sc as (select nb.user_id, game_id, round(sum(weight * rating), 9) as score from nb join ratings on ratings.user_id = nb.other group by 1, 2),
nw as (select * from sc where not exists (select 1 from ratings r where r.user_id = sc.user_id and r.game_id = sc.game_id)) select user_id, game_id, score, rank from (select *, row_number() over (partition by user_id order by score desc, game_id) as rank from nw) where rank <= 5""", (v.USERS, v.RATINGS), "score")
def recommend_similar(spark, sf):
    return s.recommend_similar(v.ratings(spark, sf), _neighbours(spark, sf, "vec_id % 100 = 0 or vec_id < 10"), 5)


def _players(spark, sf):
    return v.users(spark, sf).select(F.col("id").alias("user_id"), (F.col("win_rate") / 100).alias("risk_tolerance"), (F.col("total_bets") / F.col("bet_count") / 100).alias("avg_bet"), F.array(F.lit("ECONOMY"), F.lit("PROMO")).alias("game_categories"), (10.0 + F.col("bet_count") % 50).alias("session_duration"))


_PLAYERS = ", pl as (select id as user_id, win_rate / 100 as risk_tolerance, total_bets / bet_count / 100 as avg_bet, 10.0::double + bet_count % 50 as session_duration from users)"
_RULES = """, ra as (select user_id, game_id, round(case when rtp > 0.96 then 0.2 else 0 end::double + case when risk_tolerance > 0.7 and volatility = 'high' then 0.3 when risk_tolerance < 0.4 and volatility = 'low' then 0.3 when volatility = 'medium' then 0.1 else 0 end::double + case when avg_bet between min_bet and max_bet then 0.2 else 0 end::double + case when category in ('ECONOMY', 'PROMO') then 0.2 else 0 end::double + case when abs(avg_session_duration - session_duration) < 5 then 0.1 else 0 end::double, 9) as score from pl, games),
ru as (select user_id, game_id, score from (select *, row_number() over (partition by user_id order by score desc, game_id) as k from ra) where k <= 50)"""
_POPULAR = ", pn as (select game_id, count(distinct user_id) p from ratings group by 1), po as (select game_id, p / (select max(p) from pn) as score from pn order by score desc, game_id limit 10)"


def _rules(spark, sf):
    return s.recommend_rules(_players(spark, sf), v.games(spark, sf))


@query(_PLAYERS + _RULES + " select * from ru", (v.USERS, v.GAMES), "score")
def recommend_rules(spark, sf):
    return _rules(spark, sf)


@query(_PLAYERS + _RULES + " select ru.user_id, ru.game_id, score, avg_session_duration as engagement_minutes, avg_bet * avg_session_duration / 60 as revenue_potential from ru join games on games.game_id = ru.game_id join pl on pl.user_id = ru.user_id", (v.USERS, v.GAMES), "score engagement_minutes revenue_potential")
def recommend_value(spark, sf):
    return s.recommend_value(_rules(spark, sf), _players(spark, sf), v.games(spark, sf)).select("user_id", "game_id", "score", "engagement_minutes", "revenue_potential")


_TERMS = "list_filter(string_split_regex(lower({}), '[^a-z0-9_]+'), lambda w: len(w) > 1)"
_CONTENT = f""", fav as (select user_id, max_by(game_id, [rating::double, -game_id::double]) as g from ratings group by 1), ut as (select user_id, category || ' ' || provider || ' volatility_' || volatility as text from fav join games on games.game_id = fav.g), gt as (select game_id, category || ' ' || provider || ' volatility_' || volatility || ' rtp_' || cast(floor(rtp * 100) as int) as text from games),
gw as (select game_id, {_TERMS.format('text')} as w from gt), uw as (select distinct text, {_TERMS.format('text')} as w from ut), g1 as (select game_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from gw), u1 as (select text, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from uw),
gf as (select game_id, term, count(*) as tf from g1 group by 1, 2), uf as (select text, term, count(*) as tf from u1 group by 1, 2), vo as (select term, sum(tf) as a, count(*) as df from gf group by 1 order by a desc, term limit 1000), id as (select term, ln((1 + (select count(*) from games)) / (1 + df)) + 1 as idf from vo),
gx as (select game_id, term, tf * idf as w from gf join id using (term)), ux as (select text, term, tf * idf as w from uf join id using (term)), gl as (select game_id, sqrt(sum(w * w)) as l from gx group by 1), ul as (select text, sqrt(sum(w * w)) as l from ux group by 1),
sc as (select text, game_id, round(sum(ux.w / ul.l * gx.w / gl.l), 9) as score from ux join ul using (text) join gx using (term) join gl using (game_id) group by 1, 2), be as (select * from (select *, row_number() over (partition by text order by score desc, game_id) as k from sc) where k <= 20)"""


def _content(spark, sf, ratings=None):
    games = v.games(spark, sf)
    text = F.concat_ws(" ", "category", "provider", F.concat(F.lit("volatility_"), "volatility"))
    fav = (v.ratings(spark, sf) if ratings is None else ratings).groupBy("user_id").agg(F.max_by("game_id", F.struct("rating", -F.col("game_id"))).alias("game_id"))
    described = games.select("game_id", F.concat_ws(" ", text, F.concat(F.lit("rtp_"), F.floor(F.col("rtp") * 100).cast("int"))).alias("text"))
    return s.recommend_content(fav.join(games.select("game_id", text.alias("text")), "game_id").select("user_id", "text"), described, 20)


@query(_CONTENT + " select user_id, game_id, score from ut join be using (text)", (v.RATINGS, v.GAMES), "score")
def recommend_content(spark, sf):
    return _content(spark, sf)


def _ratings(spark, sf):
    """Made once for all recommenders."""
    return written(v.ratings(spark, sf).select("user_id", "game_id", "rating"), "ratings")


def _hybrid_parts(spark, sf, ratings):
    """The recommenders that read no learned model."""
    top = s.recommend_popular(ratings)  # ten rows
    return {"content": _content(spark, sf, ratings), "similar": s.recommend_similar(ratings, _neighbours(spark, sf), 5), "popular": v.users(spark, sf).select(F.col("id").alias("user_id")).crossJoin(F.broadcast(top))}


@query(_NEAR_ALL + _CONTENT + _POPULAR + """, si as (select nb.user_id, game_id, round(sum(weight * rating), 9) as score from nb join ratings on ratings.user_id = nb.other group by 1, 2),
sn as (select * from si where not exists (select 1 from ratings r where r.user_id = si.user_id and r.game_id = si.game_id)), st as (select *, row_number() over (partition by user_id order by score desc, game_id) as rank from sn),
u as (select user_id, game_id, score * 0.3::double as s, 'content' as source from ut join be using (text) union all select user_id, game_id, score * 0.2::double, 'similar' from st where rank <= 5 union all select id, game_id, score * 0.1::double, 'popular' from po, users)
select user_id, game_id, sum(s) as score, string_agg(distinct source, ',' order by source) as sources from u group by 1, 2""", (v.USERS, v.GAMES, v.RATINGS), "score")
def recommend_hybrid(spark, sf):
    """Content, similar users and popularity; ``recommend_hybrid_learned`` adds factors."""
    return s.recommend_hybrid(_hybrid_parts(spark, sf, _ratings(spark, sf)))


@query()
def recommend_hybrid_learned(spark, sf):
    """All four recommenders."""
    ratings = _ratings(spark, sf)
    return s.recommend_hybrid({"collaborative": s.recommend_cf(ratings, 5), **_hybrid_parts(spark, sf, ratings)})


@query(_PLAYERS + _RULES + """, ap as (select ru.user_id, ru.game_id, round(ru.score * case when release_date > date '2024-01-01' then 1.2 else 1 end::double * case when rtp > 0.97 then 1.1 else 1 end::double, 9) as score, category, provider from ru join games on games.game_id = ru.game_id where score >= 0.3 and ru.game_id % 9 <> 0),
f as (select *, row_number() over (partition by user_id, category order by score desc, game_id) c, row_number() over (partition by user_id, provider order by score desc, game_id) p from ap)
select user_id, game_id, score * case when c = 1 then 1.3 else 1 end::double * case when p = 1 then 1.2 else 1 end::double as score from f""", (v.USERS, v.GAMES), "score")
def diversify(spark, sf):
    rules = written(_rules(spark, sf), "rules")
    excluded = rules.where("game_id % 9 = 0").select("user_id", "game_id")
    kept = s.apply_rules(rules, v.games(spark, sf), excluded).withColumn("score", F.round("score", 9))
    return s.diversify(kept).select("user_id", "game_id", "score")


@query()
def recommend_cf(spark, sf):
    return s.recommend_cf(v.ratings(spark, sf), 5)


_TARGETS = """, tu as (select id as user_id, ltv / 100 as lifetime_value, bet_count::double as session_frequency, churn_risk, registration_days, days_since_last_activity as inactive_days, win_rate / 100 as conversion, total_bets / bet_count as avg_bet, case when id % 2 = 0 then ['slots'] when id % 3 = 0 then ['esportes'] else ['poker'] end as game_categories
from (select f.*, users.bet_count from f join users on users.id = f.id)), ts as (select *, case when lifetime_value > 2000 then 'high_value' when lifetime_value > 500 and session_frequency > 10 then 'vip' when session_frequency > 15 then 'frequent_player' when churn_risk > 0.7 then 'at_risk' when registration_days < 30 then 'new_user' when inactive_days > 30 then 'dormant'
when list_contains(game_categories, 'esportes') then 'sports_bettor' when list_contains(game_categories, 'slots') then 'slot_lover' when list_contains(game_categories, 'roleta') then 'table_game_player' else 'casual_player' end as segment from tu)"""
_CAMPAIGN = """, ca(campaign_id, target_segments, min_ltv, max_ltv, min_frequency, max_churn, preferred_games, expected_roi, duration_days) as (values (1, ['high_value', 'vip'], 0.0, 1e9, 1.0, 1.0, []::varchar[], 3.5, 7), (2, ['dormant', 'at_risk'], -1e9, 1e9, 0.0, 1.0, ['slots', 'poker'], 2.0, 14)),
el as (select ts.*, ca.* from ts join ca on list_contains(ca.target_segments, ts.segment) where lifetime_value between min_ltv and max_ltv and session_frequency >= min_frequency and churn_risk <= max_churn and (len(preferred_games) = 0 or list_has_any(preferred_games, game_categories)))"""


def _targets(spark, sf):
    from .segments import _features

    users = v.users(spark, sf).select("id", "bet_count")
    f = _features(spark, sf).join(users, "id")
    cats = F.when(F.col("id") % 2 == 0, F.array(F.lit("slots"))).when(F.col("id") % 3 == 0, F.array(F.lit("esportes"))).otherwise(F.array(F.lit("poker")))
    return s.targeting_segment(f.select(F.col("id").alias("user_id"), (F.col("ltv") / 100).alias("lifetime_value"), F.col("bet_count").cast("double").alias("session_frequency"), "churn_risk", "registration_days", F.col("days_since_last_activity").alias("inactive_days"), (F.col("win_rate") / 100).alias("conversion"), (F.col("total_bets") / F.col("bet_count")).alias("avg_bet"), cats.alias("game_categories")))


def _campaigns(spark):
    return spark.createDataFrame([(1, ["high_value", "vip"], 0.0, 1e9, 1.0, 1.0, [], 3.5, 7), (2, ["dormant", "at_risk"], -1e9, 1e9, 0.0, 1.0, ["slots", "poker"], 2.0, 14)], "campaign_id int, target_segments array<string>, min_ltv double, max_ltv double, min_frequency double, max_churn double, preferred_games array<string>, expected_roi double, duration_days int")


def _sql_features():
    from .segments import _FEATURES

    return _FEATURES


@query(_sql_features() + _TARGETS + " select user_id, segment from ts", (v.USERS,))
def targeting_segment(spark, sf):
    return _targets(spark, sf).select("user_id", "segment")


@query(_sql_features() + _TARGETS + _CAMPAIGN + " select user_id, campaign_id from el", (v.USERS,))
def eligible(spark, sf):
    return s.eligible(_targets(spark, sf), _campaigns(spark)).select("user_id", "campaign_id")


_SCORED = """, sc as (select *, least(1, (conversion * 0.4::double + (1 - churn_risk) * 0.3::double + least(1, lifetime_value / 1000) * 0.2::double + session_frequency / 100 * 0.1::double) * case when expected_roi > 3 then 1.1 else 1 end::double * 1.05::double * (1 + len(list_intersect(preferred_games, game_categories)) * 0.02::double)) as score, conversion * avg_bet * duration_days as expected_revenue from el)"""


def _scored(spark, sf):
    rows = s.eligible(_targets(spark, sf), _campaigns(spark)).withColumns({"predicted_ltv": F.col("lifetime_value"), "engagement": F.col("session_frequency") / 100})
    return s.targeting_score(rows)


@query(_sql_features() + _TARGETS + _CAMPAIGN + _SCORED + " select user_id, campaign_id, score, expected_revenue, case segment when 'high_value' then 'Exclusive VIP' when 'new_user' then 'Welcome Bonus' when 'at_risk' then 'Special Comeback' else 'Standard' end as offer, case when conversion > 0.5 then 'peak_engagement' when segment = 'dormant' then 'weekend_afternoon' else 'default' end as send_time from sc", (v.USERS,), "score expected_revenue")
def targeting_score(spark, sf):
    return s.personalize(_scored(spark, sf)).select("user_id", "campaign_id", "score", "expected_revenue", "offer", "send_time")


@query(_sql_features() + _TARGETS + _CAMPAIGN + """, sd as (select el.*, bonus_usage, session_frequency / 100 as engagement from el join (select user_id, count(converted_at) / count(*)::double as bonus_usage from results group by 1) using (user_id))
select user_id, campaign_id, least(1, conversion * 0.4::double + (1 - churn_risk) * 0.3::double + least(1, lifetime_value / 1000) * 0.2::double + engagement * 0.1::double) as confidence, greatest(0, 0.2::double - churn_risk) as churn_risk_reduction, engagement * 0.5::double as engagement_lift,
concat_ws('; ', case when conversion > 0.3 then 'High conversion probability (' || printf('%.2f%%', round(conversion * 100, 2)) || ')' end, case when churn_risk < 0.3 then 'Low churn risk' end, case when lifetime_value > 1000 then 'High predicted lifetime value' end, 'Perfect fit for ' || segment || ' segment') as reasons,
concat_ws('; ', case when churn_risk > 0.7 then 'High churn risk' end, case when inactive_days > 14 then 'Recent inactivity' end, case when conversion < 0.1 then 'Low conversion probability' end) as risk_factors,
concat_ws('; ', case when bonus_usage < 0.3 then 'Consider bonus education content' end, case when engagement < 0.5 then 'Add gamification elements' end) as suggestions from sd""", (v.USERS, v.RESULTS), "confidence churn_risk_reduction engagement_lift")
def targeting_details(spark, sf):
    """Reasons, risks, suggestions and lifts of scored users; the share of sends that converted stands for the use of bonuses."""
    used = v.campaign_results(spark, sf).groupBy("user_id").agg((F.count("converted_at") / F.count("*")).alias("bonus_usage"))
    rows = s.targeting_details(_scored(spark, sf).join(used, "user_id"))
    lists = [F.array_join(x, "; ").alias(x) for x in ("reasons", "risk_factors", "suggestions")]
    return rows.select("user_id", "campaign_id", "confidence", "churn_risk_reduction", "engagement_lift", *lists)


@query(_sql_features() + _TARGETS + _CAMPAIGN + _SCORED + " select user_id, campaign_id, score from sc where score >= 0.4 order by score desc, user_id limit 100", (v.USERS,), "score")
def target(spark, sf):
    return s.target(_scored(spark, sf), 0.4, 100).select("user_id", "campaign_id", "score")


@query()
def portfolio(spark, sf):
    rows = v.campaign_results(spark, sf).groupBy("user_id", "campaign_id").agg(F.count("*").cast("double").alias("cost"), (F.sum("conversion_value") / 1e5).alias("roi"))
    return s.portfolio(rows, 500.0)


@query()
def outcome_models(spark, sf):
    """Outcomes of all users by models of their own results: a conversion in a campaign, no activity for 90 days, the sum of
    bets, and the share of opened sends."""
    sends = v.campaign_results(spark, sf).groupBy("user_id").agg(F.max(F.col("converted_at").isNotNull().cast("int")).alias("converted"), F.avg(F.col("opened_at").isNotNull().cast("double")).alias("engaged"))
    since = lambda x: (F.lit(v.ORDERS_AS_OF).cast("double") - F.col(x).cast("double")) / 86400
    users = v.users(spark, sf).select(
        F.col("id").alias("user_id"), (F.col("total_bets") / F.col("bet_count") / 1000).alias("avg_bet"), F.col("bet_count").alias("session_frequency"), (F.col("win_rate") / 100).alias("win_rate"), "total_deposits",
        since("registration_date").alias("days_since_registration"), since("last_activity").alias("days_since_last_activity"), F.col("total_bets").alias("ltv"), (since("last_activity") > 90).cast("int").alias("churned"))
    rows = users.join(sends, "user_id")
    models = s.fit_outcomes(rows, trees=10, forest_depth=5, boosted_depth=3)
    return s.predict_outcomes(models, users).select("user_id", "conversion", "churn_risk", "predicted_ltv", "engagement")


@query()
def hdbscan(spark, sf):
    return hierarchy.hdbscan(_matrix(spark, sf), "user_id", "features", 15, 5, dimensions=3).labels


@query()
def hdbscan_auto(spark, sf):
    return hierarchy.hdbscan_auto(_matrix(spark, sf), "user_id", "features", [10, 15, 25, 40], [5], dimensions=3)[1]


@query()
def indexed_search(spark, sf):
    """Neighbours by a stored index of which a part was built, a part joined later and a part was deleted."""
    vectors = v.vectors(spark, sf)
    index = vector_index.VectorIndex.build(vectors.where("vec_id % 10 < 8"), folder(spark, "index"), buckets=16)
    index = index.upsert(vectors.where("vec_id % 10 >= 7"), batch=0).delete(vectors.where("vec_id % 13 = 0").select("vec_id"), batch=1)
    return index.search(vectors.where("vec_id % 100 = 0"), 10, index.probes_for(10))


@query()
def outlier_scores(spark, sf):
    return hierarchy.outlier_scores(_matrix(spark, sf), "user_id", "features", 0.9, 4, 3)
