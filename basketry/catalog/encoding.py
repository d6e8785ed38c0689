"""Vocabularies, encodings, the feature matrix and joins."""

from pyspark.sql import functions as F

from basketry.catalog.base import CONFIG, EXCLUDED, FINELINES, UPCS, fixed_probabilities, over_lines, register, rounded
from basketry.catalog.visits import ALL_SCALARS_SQL, GROUP_SQL, SCALAR_SQL
from basketry.functions.columns import vector_parts
from basketry.operators import clean, distances, encode, metrics, neighbors, sets, visits, vocabulary
from basketry.operators.joins import join_blocks
from basketry.plans.features import FeatureModel, triples, vector_triples
from basketry.plans.workflow import chi2_of_blocks, prepare_test, prepare_train
from basketry.session import fresh_path
from basketry.sources.tables import star_scan_lines, table, scoring_lines, training_lines

DEPT, FINE = "department_description", "fineline_number"
MERGED = f"case when {DEPT} = 'Brand#24' then 'Brand#25' else {DEPT} end"


def frequent_sql(column, more_than, source="scans", excluded=True):
    rule = f"and {DEPT} is not null and {DEPT} <> '{EXCLUDED}'" if excluded else ""
    return f"select {column}, count(*) as n from {source} where {column} is not null {rule} group by 1 having count(*) > {more_than}"


@over_lines("dept_vocab", f"select {DEPT}, row_number() over (order by {DEPT}) - 1 as feature_idx from (select distinct {DEPT} from train where {DEPT} is not null) d")
def dept_vocab(lines):
    return vocabulary.indexed_departments(training_lines(lines))


@over_lines("fineline_vocab", frequent_sql(FINE, FINELINES))
def fineline_vocab(lines):
    return vocabulary.frequent(lines, FINE, FINELINES, EXCLUDED)


@over_lines(
    "fineline_vocab_indexed",
    f"select {FINE}, n, row_number() over (order by cast({FINE} as varchar)) - 1 as feature_idx from ({frequent_sql(FINE, FINELINES)}) v",
)
def fineline_vocab_indexed(lines):
    return vocabulary.indexed_frequent(lines, FINE, FINELINES, EXCLUDED)


@over_lines("upc_vocab", frequent_sql("upc", UPCS))
def upc_vocab(lines):
    return vocabulary.frequent(lines, "upc", UPCS, EXCLUDED)


ONEHOT_SQL = f"""select visit_number, upc, scan_count, {DEPT}, feature_idx, cast(1 as double) as {{value}} from ne
join (select {DEPT} as d, row_number() over (order by {DEPT}) - 1 as feature_idx from (select distinct {DEPT} from ne) u) v on d = {DEPT}"""
ONEHOT = ["visit_number", "upc", "scan_count", DEPT, "feature_idx"]


@over_lines("dept_onehot_line", ONEHOT_SQL.format(value="value"))
def dept_onehot_line(lines):
    return encode.onehot_lines(lines, vocabulary.indexed_departments(lines)).select(*ONEHOT, "value")


@over_lines("tfidf_line", ONEHOT_SQL.format(value="tfidf"))
def tfidf_line(lines):
    return encode.tfidf_lines(lines, vocabulary.indexed_departments(lines)).select(*ONEHOT, "tfidf")


@over_lines("dept_line_counts", f"select visit_number, {MERGED} as {DEPT}, count(*) as n_lines from ne group by 1, 2")
def dept_line_counts(lines):
    return encode.dept_line_counts(lines, CONFIG.merges)


BRANDS = [f"Brand#{i}" for i in range(1, 26) if i != 24]


@over_lines(
    "dept_line_counts_wide",
    "select visit_number, "
    + ", ".join(f"count(case when {MERGED} = '{b}' then 1 end) as {b.replace('#', '_').lower()}" for b in BRANDS)
    + " from ne group by 1",
)
def dept_line_counts_wide(lines):
    wide = encode.dept_line_counts_wide(lines, BRANDS, CONFIG.merges)
    return wide.select("visit_number", *[F.col(f"`{b}`").alias(b.replace("#", "_").lower()) for b in BRANDS])


@over_lines("dept_scan_counts", f"select visit_number, {DEPT}, cast(sum(scan_count) as bigint) as scan_sum from ne group by 1, 2")
def dept_scan_counts(lines):
    return encode.dept_scan_counts(lines)


@over_lines(
    "fineline_scan_counts",
    f"""select s.visit_number, s.{FINE}, cast(sum(s.scan_count) as bigint) as scan_sum from ne s
    join ({frequent_sql(FINE, FINELINES)}) v on v.{FINE} = s.{FINE} group by 1, 2""",
)
def fineline_scan_counts(lines):
    return encode.value_scan_counts(lines, FINE, vocabulary.frequent(lines, FINE, FINELINES, EXCLUDED))


@over_lines(
    "upc_indicator_counts",
    f"""select s.visit_number, s.upc, count(*) as n_lines from ne s
    join ({frequent_sql("upc", UPCS)}) v on v.upc = s.upc group by 1, 2""",
)
def upc_indicator_counts(lines):
    return encode.value_line_counts(clean.nonempty_lines(lines), "upc", vocabulary.frequent(lines, "upc", UPCS, EXCLUDED))


@over_lines(
    "fineline_indicator_counts",
    f"""select s.visit_number, s.{FINE}, count(*) as n_lines from scans s
    join ({frequent_sql(FINE, FINELINES, excluded=False)}) v on v.{FINE} = s.{FINE} group by 1, 2""",
)
def fineline_indicator_counts(lines):
    return encode.value_line_counts(lines, FINE, vocabulary.frequent(lines, FINE, FINELINES, None))


@over_lines(
    "upc_indicator_profile",
    f"""select s.visit_number, s.upc, count(*) as n_lines from scans s
    join ({frequent_sql("upc", UPCS, excluded=False)}) v on v.upc = s.upc group by 1, 2""",
)
def upc_indicator_profile(lines):
    return encode.value_line_counts(lines, "upc", vocabulary.frequent(lines, "upc", UPCS, None))


TFIDF_SQL = f"""
with t as (select visit_number, {DEPT}, 1 + ln(count(*)) as tf from ne group by 1, 2),
n as (select cast(count(distinct visit_number) as double) as n from t),
df as (select {DEPT}, cast(count(*) as double) as df from t group by 1),
w as (select t.visit_number, t.{DEPT}, tf * (ln((1 + n) / (1 + df)) + 1) as w from t join df on df.{DEPT} = t.{DEPT} cross join n)
select visit_number, {DEPT}, round(w / sqrt(sum(w * w) over (partition by visit_number)), 6) as tfidf from w"""


@over_lines("tfidf_visit", TFIDF_SQL)
def tfidf_visit(lines):
    return rounded(encode.tfidf_visits(lines), "tfidf")


# The feature matrix -----------------------------------------------------------------------------------------------


def encoded_sql(source, share=True):
    """All encoded entries of the visits in ``source``, with the vocabularies of the training visits."""
    kept = f"(select * from {source} where {DEPT} is not null)"
    blocks = [
        f"""select visit_number, 'dept_lines=' || {MERGED} as feature, cast(count(*) as double) as value from {kept} s
        where {MERGED} in (select {MERGED} from train where {DEPT} is not null) group by 1, 2""",
        f"""select visit_number, 'dept_scans=' || {DEPT} as feature, cast(sum(scan_count) as double) as value from {kept} s
        where {DEPT} in (select {DEPT} from train where {DEPT} is not null) group by 1, 2""",
        f"""select visit_number, 'fineline_scans=' || cast({FINE} as varchar) as feature, cast(sum(scan_count) as double) as value from {kept} s
        where {FINE} in (select {FINE} from ({frequent_sql(FINE, FINELINES, "train")}) v) group by 1, 2""",
        f"""select visit_number, 'upc_lines=' || cast(upc as varchar) as feature, cast(count(*) as double) as value from {kept} s
        where upc in (select upc from ({frequent_sql("upc", UPCS, "train")}) v) group by 1, 2""",
    ]
    if share:
        blocks.append(
            f"""select visit_number, 'dept_share=' || {DEPT} as feature, value from (
              select visit_number, {DEPT}, cast(count(*) as double) / cast(sum(count(*)) over (partition by visit_number) as double) as value
              from {kept} s group by 1, 2) q where {DEPT} in (select {DEPT} from train where {DEPT} is not null)"""
        )
    return "\nunion all\n".join(blocks)


def matrix_sql(source):
    """Every non-zero entry of the matrix."""
    kept = f"(select * from {source} where {DEPT} is not null) s"
    scalars = ", ".join(f"cast({e} as double) as {n}" for n, e in SCALAR_SQL.items())
    wide = f"select visit_number, {scalars}, {GROUP_SQL} from {kept} group by 1"
    names = [*SCALAR_SQL, *CONFIG.groups]
    fixed = "\nunion all\n".join(f"select visit_number, '{n}' as feature, cast({n} as double) as value from wide" for n in names)
    return f"""with wide as ({wide})
    select visit_number, feature, round(value, 6) as value from ({fixed}\nunion all\n{encoded_sql(source)}) e where value <> 0"""


def named(entries, model):
    return rounded(entries.join(F.broadcast(model.names()), "feature_idx").select("visit_number", "feature", "value"), "value")


@over_lines("matrix_sum", f"select visit_number, feature, value from ({encoded_sql('train', share=False)}) e where value <> 0", written=True)
def matrix_sum(lines):
    """The encoded blocks as the single operators give them."""
    train = training_lines(lines)

    def block(df, name, column, value):
        feature = F.concat(F.lit(f"{name}="), F.col(column).cast("string")).alias("feature")
        return df.select("visit_number", feature, F.col(value).cast("double").alias("value"))

    finelines = vocabulary.frequent(train, FINE, FINELINES, EXCLUDED)
    upcs = vocabulary.frequent(train, "upc", UPCS, EXCLUDED)
    kept = clean.nonempty_lines(train)
    return (
        block(encode.dept_line_counts(train, CONFIG.merges), "dept_lines", DEPT, "n_lines")
        .unionByName(block(encode.dept_scan_counts(train), "dept_scans", DEPT, "scan_sum"))
        .unionByName(block(encode.value_scan_counts(train, FINE, finelines), "fineline_scans", FINE, "scan_sum"))
        .unionByName(block(encode.value_line_counts(kept, "upc", upcs), "upc_lines", "upc", "n_lines"))
        .filter("value <> 0")
    )


@over_lines("assemble_matrix", matrix_sql("train"), written=True)
def assemble_matrix(lines):
    """The entries of the training vectors, read back from the vectors."""
    model, matrix = prepare_train(training_lines(lines), CONFIG)
    return named(vector_triples(matrix), model)


@over_lines("shared_vocab_columns", matrix_sql("test"), written=True)
def shared_vocab_columns(lines):
    """The entries of the test visits in the columns fitted on the training visits."""
    model = FeatureModel.fit(training_lines(lines), CONFIG)
    return named(triples(prepare_test(scoring_lines(lines), model)), model)


@over_lines("visit_feature_entries", matrix_sql("scans"), written=True)
def visit_feature_entries(lines):
    """The entries of the vectors of all visits, with the vocabularies of the training visits."""
    model = FeatureModel.fit(training_lines(lines), CONFIG)
    return named(vector_triples(model.matrix(lines)), model)


@over_lines(
    "chi2_blocks",
    f"""select * from (with x as (
      select e.feature, l.trip_type, e.value from ({matrix_sql("train")}) e join (select visit_number, max(trip_type) as trip_type from train where {DEPT} is not null group by 1) l
      on l.visit_number = e.visit_number
      where regexp_matches(e.feature, '^(dept_share|dept_lines|upc_lines)=') or e.feature in ({", ".join(f"'{g}'" for g in CONFIG.groups)})),
    cp as (select trip_type, count(*) / sum(count(*)) over () as share from (
      select visit_number, max(trip_type) as trip_type from train where {DEPT} is not null group by 1) v group by 1),
    fs as (select feature, sum(value) as total from x group by 1),
    ob as (select feature, trip_type, sum(value) as o from x group by 1, 2),
    s as (
      select fs.feature, sum(pow(coalesce(o, 0) - share * total, 2) / (share * total)) as chi2, count(*) - 1 as degrees
      from fs cross join cp left join ob on ob.feature = fs.feature and ob.trip_type = cp.trip_type group by 1)
    select feature, round(chi2, 4) as chi2, round(list_sum(list_transform(generate_series(0, degrees // 2 - 1),
      lambda i: exp(-chi2 / 2 + i * ln(chi2 / 2) - lgamma(i + 1)))), 4) as p_value from s) c""",
    written=True,
)
def chi2_blocks(lines):
    """Scores and p-values of all features of the training matrix that cannot be negative, with degrees of freedom from the data."""
    model, matrix = prepare_train(training_lines(lines), CONFIG)
    return rounded(chi2_of_blocks(matrix, model), "chi2", "p_value", places=4)


VOCAB_SQL = f"""select feature, row_number() over (order by place, value) + 12 as feature_idx from (
  select 0 as place, d as value, 'dept_share=' || d as feature from (select distinct {DEPT} as d from train where {DEPT} is not null) t
  union all select distinct 1, {MERGED}, 'dept_lines=' || {MERGED} from train where {DEPT} is not null
  union all select 2, d, 'dept_scans=' || d from (select distinct {DEPT} as d from train where {DEPT} is not null) t
  union all select 3, cast({FINE} as varchar), 'fineline_scans=' || cast({FINE} as varchar) from ({frequent_sql(FINE, FINELINES, "train")}) v
  union all select 4, cast(upc as varchar), 'upc_lines=' || cast(upc as varchar) from ({frequent_sql("upc", UPCS, "train")}) v) u"""


def whole_sql(source, labelled=True):
    """The wide part of the rows, and the number and text of the vector entries: position:millionths, in order."""
    names = [*SCALAR_SQL, *CONFIG.groups]
    fixed = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    label = "max(trip_type) as trip_type, " if labelled else ""
    return f"""select * from (with places as (select feature, feature_idx from ({VOCAB_SQL}) v union all select * from (values {fixed}) f(feature, feature_idx)),
    wide_rows as (select visit_number, {label}{ALL_SCALARS_SQL}, {GROUP_SQL}, count(*) as n_lines from {source} where {DEPT} is not null group by 1),
    fixed_rows as (select w.visit_number, f.i as feature_idx, f.v as value from wide_rows w,
      lateral (select unnest(range({len(names)})) as i, unnest([{", ".join(f"cast({n} as double)" for n in names)}]) as v) f),
    every as (
      select * from fixed_rows
      union all select e.visit_number, p.feature_idx, e.value from ({encoded_sql(source)}) e join places p on p.feature = e.feature),
    texts as (
      select visit_number, cast(count(*) as int) as n_entries,
        string_agg(feature_idx || ':' || cast(floor(value * 1000000 + 0.5) as bigint), ',' order by feature_idx) as entries
      from every where value <> 0 group by 1)
    select w.*, coalesce(n_entries, 0) as n_entries, coalesce(entries, '') as entries from wide_rows w left join texts t on t.visit_number = w.visit_number) m"""


def _whole(matrix):
    """The rows with the entries of their vectors as text."""
    positions, values = vector_parts()
    parts = F.transform(F.arrays_zip(positions.alias("i"), values.alias("v")), lambda e: F.concat(e["i"], F.lit(":"), F.floor(e["v"] * 1_000_000 + 0.5)))
    return matrix.withColumns({"n_entries": F.size(positions), "entries": F.array_join(parts, ",")}).drop("features")


@over_lines("visit_feature_matrix", whole_sql("scans"), written=True)
def visit_feature_matrix(lines):
    """All visits with the vocabularies of the training visits, vectors included."""
    return _whole(FeatureModel.fit(training_lines(lines), CONFIG).matrix(lines))


@over_lines("prepare_train", whole_sql("train"), written=True)
def prepared_train(lines):
    return _whole(prepare_train(training_lines(lines), CONFIG)[1])


@over_lines("prepare_test", whole_sql("test", labelled=False), written=True)
def prepared_test(lines):
    model = FeatureModel.fit(training_lines(lines), CONFIG)
    return _whole(prepare_test(scoring_lines(lines).drop("trip_type"), model))



@register("vocab_persist", VOCAB_SQL)
def vocab_persist(spark, directory):
    """The fitted vocabulary, saved and loaded again."""
    path = fresh_path(spark, "feature-model")
    FeatureModel.fit(training_lines(star_scan_lines(spark, directory)), CONFIG).save(path)
    features = FeatureModel.load(spark, path).features
    return features.select(F.concat_ws("=", "block", "value").alias("feature"), F.col("feature_idx").cast("bigint").alias("feature_idx"))


# Joins ------------------------------------------------------------------------------------------------------------


@over_lines(
    "join_feature_blocks",
    f"""select a.*, b.* exclude (visit_number), c.n_depts from (select visit_number, {ALL_SCALARS_SQL} from ne group by 1) a
    join (select visit_number, {GROUP_SQL} from ne group by 1) b on b.visit_number = a.visit_number
    join (select visit_number, count(distinct {MERGED}) as n_depts from ne group by 1) c on c.visit_number = a.visit_number""",
    written=True,
)
def join_feature_blocks(lines):
    encoded = encode.dept_line_counts(lines, CONFIG.merges).groupBy("visit_number").agg(F.count(F.lit(1)).alias("n_depts"))
    return join_blocks(visits.visit_aggregates(lines), visits.group_shares(lines, CONFIG.groups), encoded)


@over_lines(
    "join_line_blocks",
    f"""select visit_number, kind, value, count(*) as n, cast(sum(scan_count) as bigint) as scan_sum from (
      select visit_number, 'dept' as kind, {DEPT} as value, scan_count from ne
      union all select visit_number, 'fineline', cast({FINE} as varchar), scan_count from ne where {FINE} is not null
      union all select visit_number, 'upc', cast(upc as varchar), scan_count from ne where upc is not null) u group by 1, 2, 3""",
)
def join_line_blocks(lines):
    """The blocks of a line side by side: one pass that unpivots each line, instead of joining on row position."""
    kinds = {"dept": DEPT, "fineline": FINE, "upc": "upc"}
    keyed = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()])
    long = clean.nonempty_lines(lines).select("visit_number", "scan_count", F.inline(keyed)).filter("value is not null")
    return long.groupBy("visit_number", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("scan_count").alias("scan_sum"))


@over_lines("anti_empty_visits", "select visit_number from scans group by 1 having count(department_description) = 0")
def anti_empty_visits(lines):
    return visits.empty_visits_by_difference(lines)


@over_lines("join_labels", f"select visit_number, {ALL_SCALARS_SQL}, max(trip_type) as trip_type from ne group by 1", written=True)
def join_labels(lines):
    return join_blocks(visits.visit_aggregates(lines), visits.visit_labels(lines))


@over_lines(
    "pairwise_distances",
    f"""with d as (select {DEPT} as dept, cast(count(*) as double) as n from ne group by 1)
    select a.dept as dept_a, b.dept as dept_b, case when a.dept = b.dept then 0.0::double else sqrt(2.0::double) end as distance,
      case when a.dept = b.dept then a.n * (a.n - 1) / 2 else a.n * b.n end as n_line_pairs
    from d a join d b on a.dept <= b.dept""",
)
def pairwise_distances(lines):
    return distances.line_distances(lines)


KNN_SQL = """with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
r as (
  select q.vec_id as query_id, t.vec_id as neighbour_id, t.label,
    row_number() over (partition by q.vec_id order by list_sum(list_transform(generate_series(1, len(q.v)), lambda i: (q.v[i] - t.v[i]) * (q.v[i] - t.v[i]))), t.vec_id) as place
  from (select * from e where vec_id % 10 = 0) q cross join (select * from e where vec_id % 10 <> 0) t)
"""


def _embedding_neighbours(spark, directory, k):
    rows = table(spark, directory, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec"))
    test = F.col("id") % 10 == 0
    return neighbors.nearest_neighbours(rows.filter(~test), rows.filter(test), k)


@register("knn_join", KNN_SQL + "select query_id, neighbour_id, label, cast(place as int) as place from r where place <= 10")
def knn_join(spark, directory):
    return _embedding_neighbours(spark, directory, 10).select("query_id", "neighbour_id", "label", "place")


@register(
    "knn_votes",
    KNN_SQL + "select query_id, label, round(count(*) / 15.0::double, 6) as p from r where place <= 15 group by 1, 2",
)
def knn_votes(spark, directory):
    return rounded(neighbors.neighbour_votes(_embedding_neighbours(spark, directory, 15)), "p")


@over_lines(
    "join_base_probs",
    """select a.visit_number, a.trip_type, round(pow(a.p * b.p * c.p, 1.0::double / 3), 6) as p from probs a
    join probs b on b.visit_number = a.visit_number and b.trip_type = a.trip_type and b.model_index = 1
    join probs c on c.visit_number = a.visit_number and c.trip_type = a.trip_type and c.model_index = 2
    where a.model_index = 0""",
)
def join_base_probs(lines):
    probs = fixed_probabilities(lines)
    return rounded(metrics.joined_product(*[probs.filter(F.col("model_index") == i) for i in range(3)]), "p")


@over_lines(
    "ensemble_align",
    "select visit_number, trip_type, count(*) as n_models, round(max(p), 6) as p from probs group by 1, 2",
)
def ensemble_align(lines):
    probs = fixed_probabilities(lines)
    tables = [probs.filter(F.col("model_index") == i).drop("model_index") for i in range(3)]
    aligned = tables[0].unionByName(tables[1]).unionByName(tables[2])
    counted = aligned.groupBy("visit_number", "trip_type").agg(F.count(F.lit(1)).alias("n_models"))
    return rounded(counted.join(sets.max_per_key(aligned), ["visit_number", "trip_type"]), "p")
