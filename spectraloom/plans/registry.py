"""Queries of the search operators on the test tables, with the DuckDB statements that give the same rows.

Stand-ins: the residue letters of a document are a protein; orders and line
items give masses, scores and ties; events of a user are scans in order;
embeddings are peak lists.  All run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chem, names, text
from ..functions.chem import ENZYMES, RESIDUE_MASS, PrecursorTolerance, Tolerance
from ..functions.mods import VariantTable
from ..operators import digest, fdr, intensity, match, topn, train
from ..operators.digest import DigestOptions
from ..operators.chimeric import envelopes
from ..operators.match import MatchOptions
from ..operators.model import tiny_model
from ..operators.score import prepared, strongest_peaks

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LETTERS = "ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy"
SEQ = f"upper(regexp_replace(coalesce(text, ''), '[^{LETTERS}]+', '', 'g'))"


def residue_letters(column: str):
    # letters first: upper() turns one letter outside ASCII into two
    return F.upper(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), f"[^{LETTERS}]+", ""))


def doc_proteins(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    docs = table(spark, sf_dir, name)
    return docs.select(F.col(key).alias("protein_index"), F.col(key).cast("string").alias("accession"), residue_letters("text").alias("sequence"), F.lit(False).alias("is_decoy"))


@query(f"""select accession, length(sequence) as n, md5(sequence) as digest from (
  select cast(doc_id as varchar) as accession, {SEQ} as sequence from documents
  union all select 'XXX_' || cast(doc_id as varchar), reverse({SEQ}) from documents)""")
def decoy_union(spark, sf_dir):
    t = doc_proteins(spark, sf_dir)
    d = t.withColumns({"accession": names.decoy_accession(F.col("accession")), "sequence": F.reverse("sequence")})
    return t.unionByName(d).select("accession", F.length("sequence").cast("long").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("digest"))


def _digest_sql(table_name: str, key: str, missed: int, specificity: int, after: str = "KR", low: int = 6, high: int = 40) -> str:
    walks = f"with p as (select {key} as protein_index, {SEQ} as s from {table_name}), w as (select protein_index, 0 as walk, s as q from p where length(s) > 0 union all select protein_index, 1, substr(s, 2) from p where starts_with(s, 'M') and length(s) > 1)"
    strict = f""", f as (select protein_index, walk, q, string_split_regex(regexp_replace(q, '([{after}])', '\\1|', 'g'), '\\|') as parts from w),
  g as (select protein_index, walk, q, list_filter(parts, lambda x: x <> '') as parts from f),
  c as (select protein_index, walk, q, unnest(list_prepend(0, list_transform(range(1, len(parts) + 1), lambda i: cast(list_sum(list_transform(parts[1:i], lambda x: length(x))) as bigint)))) as pos, unnest(range(0, len(parts) + 1)) as k from g),
  s as (select a.protein_index, a.walk, a.q, a.pos as a, b.pos as b from c a join c b on a.protein_index = b.protein_index and a.walk = b.walk and b.k > a.k and b.k <= a.k + {missed + 1} where b.pos - a.pos between {low} and {high})"""
    every = f", st as (select protein_index, walk, q, unnest(range(0, length(q))) as a from w), e as (select protein_index, walk, q, a, unnest(range(a + {low}, least(a + {high}, length(q)) + 1)) as b from st)"
    cut = lambda x: f"({x} = 0 or {x} = length(q) or substr(q, {x}, 1) similar to '[{after}]')"
    if specificity == 2:
        body, src = strict, "s"
    elif specificity == 1:
        body, src = strict + every + f", u as (select * from s union all select * from e where {cut('a')} <> {cut('b')})", "u"
    else:
        body, src = every, "e"
    return f"""{walks}{body} select protein_index, a + walk as start_offset, substr(q, a + 1, b - a) as sequence,
  case when a > 0 then substr(q, a, 1) when walk = 1 then 'M' else '_' end as pre, case when b < length(q) then substr(q, b + 1, 1) else '-' end as post from {src}"""


def _digested(spark, sf_dir, name, key, options):
    out = digest.peptides(doc_proteins(spark, sf_dir, name, key), options)
    return out.select("protein_index", F.col("start_offset").cast("long").alias("start_offset"), "sequence", "pre", "post")


@query(_digest_sql("documents", "doc_id", 0, 2))
def tryptic_digest(spark, sf_dir):
    return _digested(spark, sf_dir, "documents", "doc_id", DigestOptions(missed=0))


@query(_digest_sql("documents", "doc_id", 1, 2))
def digest_missed(spark, sf_dir):
    return _digested(spark, sf_dir, "documents", "doc_id", DigestOptions(missed=1))


@query(_digest_sql("benchmark", "item_id", 1, 1))
def digest_semi(spark, sf_dir):
    return _digested(spark, sf_dir, "benchmark", "item_id", DigestOptions(specificity=1))


@query(_digest_sql("benchmark", "item_id", 1, 0))
def digest_nonspecific(spark, sf_dir):
    return _digested(spark, sf_dir, "benchmark", "item_id", DigestOptions(specificity=0))


@query(_digest_sql("documents", "doc_id", 2, 2, "FYWL"))
def digest_chymotrypsin(spark, sf_dir):
    return _digested(spark, sf_dir, "documents", "doc_id", DigestOptions(enzyme=ENZYMES["Chymotrypsin"], missed=2))


_MASS_SQL = " + ".join(f"{m!r}e0 * (length(s) - length(replace(s, '{r}', '')))" for r, m in RESIDUE_MASS.items())


@query(f"select doc_id, round({_MASS_SQL} + {chem.H2O!r}e0, 3) as mass from (select doc_id, {SEQ} as s from documents)")
def peptide_mass(spark, sf_dir):
    p = doc_proteins(spark, sf_dir)
    return p.select(F.col("protein_index").alias("doc_id"), F.round(chem.sequence_mass(F.col("sequence")) + chem.H2O, 3).alias("mass"))



@query("select o_orderkey, cast(round(cast(0.999497 as float) * cast(o_totalprice / 100 as float)) as integer) as nominal from orders")
def nominal_mass_bucket(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", chem.nominal(F.col("o_totalprice") / 100).alias("nominal"))


@query("""with s as (select p_partkey, upper(regexp_replace(p_name || p_type, '[^A-Za-z]+', '', 'g')) as q from part),
  m as (select p_partkey, q, length(q) - length(replace(q, 'M', '')) as k from s)
  select p_partkey, k as sites, cast(list_sum(list_transform(range(0, least(k, 3) + 1), lambda i: factorial(cast(k as integer)) / (factorial(cast(i as integer)) * factorial(cast(k - i as integer))))) as bigint) as forms from m""")
def mod_variants(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    letters = F.upper(F.regexp_replace(F.concat("p_name", "p_type"), "[^A-Za-z]+", ""))
    # residues that are none stand for glycine: only methionine has variants
    seq = F.regexp_replace(letters, "[^M]", "G")
    one = part.select("p_partkey", seq.alias("q"))
    made = one.select("q").distinct().withColumn("forms", F.size(digest.forms(F.col("q"), F.lit(False), F.lit(False), VariantTable(), 3)).cast("long"))
    return one.join(made, "q").select("p_partkey", (F.length("q") - F.length(F.replace(F.col("q"), F.lit("M"), F.lit("")))).cast("long").alias("sites"), "forms")


_TOL = 20.0


@query(f"""select o_orderkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - o_totalprice) / o_totalprice * 1e6, 4) as ppm
  from orders join lineitem on abs(l_extendedprice - o_totalprice) <= o_totalprice * {_TOL} * 1e-6""")
def precursor_range_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("spectrum_idx"), (F.col("o_totalprice") + chem.PROTON).alias("precursor_mz"), F.lit(1).alias("precursor_charge"), F.array(F.lit(0)).alias("peaks"))
    li = table(spark, sf_dir, "lineitem")
    c = li.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("cand_idx"), F.col("l_extendedprice").alias("neutral_mass"), chem.nominal(F.col("l_extendedprice") - chem.H2O).alias("nominal_residue_mass"))
    out = match.precursor_matches(o, c, MatchOptions(tolerance=PrecursorTolerance(Tolerance(_TOL), Tolerance(_TOL)), isotopes=(0, 0), min_peaks=1))
    return out.select(F.col("spectrum_idx").alias("o_orderkey"), "cand_idx.*", F.round("mass_error_ppm", 4).alias("ppm"))


_ISO = repr(chem.ISOTOPE)


@query(f"""with c as (select p_partkey as cand, cast(p_retailprice as double) + 18.0105646942 as m from part),
  s as (select s_suppkey as spec, s_acctbal / 10 + 1000 as m from supplier),
  j as (select spec, cand, iso, c.m - (s.m - iso * {_ISO}) as err, s.m - iso * {_ISO} as obs from s join c on abs(c.m - s.m) < 4 cross join (select unnest([-1, 0, 1, 2]) as iso)),
  k as (select spec, cand, iso, err / obs * 1e6 as ppm from j where abs(err) <= 0.5),
  r as (select *, row_number() over (partition by spec, cand order by abs(ppm), iso) as n from k)
  select spec, cand, cast(iso as integer) as iso, round(ppm, 4) as ppm from r where n = 1""")
def isotope_min_error(spark, sf_dir):
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_idx"), (F.col("p_retailprice") + 18.0105646942).alias("neutral_mass"))
    c = c.withColumn("nominal_residue_mass", chem.nominal(F.col("neutral_mass") - chem.H2O))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spectrum_idx"), (F.col("s_acctbal") / 10 + 1000 + chem.PROTON).alias("precursor_mz"), F.lit(1).alias("precursor_charge"), F.array(F.lit(0)).alias("peaks"))
    tol = PrecursorTolerance(Tolerance(0.5, "Da"), Tolerance(0.5, "Da"))
    out = match.precursor_matches(s, c, MatchOptions(tolerance=tol, min_peaks=1))
    return out.select(F.col("spectrum_idx").alias("spec"), F.col("cand_idx").alias("cand"), F.col("isotope_offset").alias("iso"), F.round("mass_error_ppm", 4).alias("ppm"))


_PSM = "select l_orderkey as spectrum_idx, l_linenumber as charge, l_partkey as cand, l_suppkey as supp, l_quantity as score, l_extendedprice as mass, l_discount as disc from lineitem"


def psms(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum_idx"), F.col("l_linenumber").alias("charge"), F.col("l_partkey").alias("cand"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("score"), F.col("l_extendedprice").alias("mass"), F.col("l_discount").alias("disc"))


@query(f"select spectrum_idx, charge, cand, supp, score from (select *, rank() over (partition by spectrum_idx order by score desc) as r from ({_PSM})) where r <= 2")
def topn_ties(spark, sf_dir):
    return topn.top_with_ties(psms(spark, sf_dir), ["spectrum_idx"], "score", 2).select("spectrum_idx", "charge", "cand", "supp", "score")


@query(f"""select spectrum_idx, charge, cand, supp, score from (select *, rank() over (partition by spectrum_idx order by score desc) as r from (
  select * from (select *, rank() over (partition by spectrum_idx, charge order by score desc) as q from ({_PSM})) where q <= 1)) where r <= 3""")
def topn_per_charge_merge(spark, sf_dir):
    first = topn.top_with_ties(psms(spark, sf_dir), ["spectrum_idx", "charge"], "score", 1)
    return topn.top_with_ties(first, ["spectrum_idx"], "score", 3).select("spectrum_idx", "charge", "cand", "supp", "score")


@query(f"""select spectrum_idx, supp, cast(round(score) as bigint) as score_round, string_agg(distinct cand, ',' order by cand) as cands, max(score) as score
  from ({_PSM}) group by spectrum_idx, supp, cast(round(score) as bigint)""")
def dedup_peptide_score(spark, sf_dir):
    df = psms(spark, sf_dir).select("spectrum_idx", F.lit(0).alias("charge"), F.col("supp").cast("string").alias("sequence"), F.col("cand").alias("cand_idx"), F.col("score").alias("rank_score"), F.array().cast("array<struct<mod_delta:double>>").alias("residues"))
    out = topn.dedup(df).withColumn("score_round", F.round("rank_score").cast("long"))
    return out.select("spectrum_idx", F.col("sequence").cast("long").alias("supp"), "score_round", F.array_join(F.transform("candidate_idxs", lambda x: x.cast("string")), ",").alias("cands"), F.col("rank_score").alias("score"))


@query(f"""with b as (select spectrum_idx, cand, max(score) as s from ({_PSM}) group by all), l as (select spectrum_idx, list(s order by s desc) as v from b group by 1)
  select spectrum_idx, case when len(v) >= 2 then v[1] - v[2] else 0.0 end as delta from l""")
def delta_score(spark, sf_dir):
    df = psms(spark, sf_dir).select("spectrum_idx", F.lit(0).alias("charge"), F.col("cand").alias("mass_key"), "score")
    return topn.delta_score(df).select("spectrum_idx", "delta")


@query(f"""with r as (select supp, round(score) as s, row_number() over (partition by supp order by round(score) desc) as k, count(*) over (partition by supp) as n from ({_PSM}))
  select supp, n, case when n >= 100 and max(case when k = cast(ceil(n * 0.01) as bigint) then s end) > 0 then max(case when k = cast(ceil(n * 0.01) as bigint) then s end) else 1.0 end as tailor from r group by supp, n""")
def tailor_score(spark, sf_dir):
    return topn.tailor(psms(spark, sf_dir).select("supp", "score"), ["supp"]).select("supp", "n", "tailor")


@query(f"""with m as (select spectrum_idx, score, max(score) over (partition by spectrum_idx) as top from ({_PSM})), e as (select *, exp(score - top) / sum(exp(score - top)) over (partition by spectrum_idx) as p from m),
  g as (select spectrum_idx, count(*) as n, sum(case when p > 0 then -p * ln(p) else 0 end) as h, list(score order by score desc) as v from e group by 1)
  select spectrum_idx, n, round(case when n < 2 then 0.0 else h end, 6) as entropy, case when n < 2 then 0.0 else v[1] - v[2] end as gap from g""")
def listwise_entropy(spark, sf_dir):
    out = topn.listwise(psms(spark, sf_dir).select("spectrum_idx", "score"), "spectrum_idx", "score")
    return out.groupBy("spectrum_idx").agg(F.count("*").alias("n"), F.round(F.max("entropy"), 6).alias("entropy"), F.max("gap").alias("gap"))


@query(f"""with w as (select spectrum_idx, charge, cand, supp, score, count(*) over p - 1 as n, sum(score) over p - score as s, sum(score * score) over p - score * score as q from ({_PSM}) window p as (partition by spectrum_idx))
  select spectrum_idx, charge, cand, supp, round(case when n > 0 then (score - s / n) / greatest(sqrt(greatest(q / n - (s / n) * (s / n), 0)), 1e-6) else 0.0 end, 3) as loo from w""")
def loo_zscore(spark, sf_dir):
    return topn.leave_one_out(psms(spark, sf_dir), "spectrum_idx", "score").select("spectrum_idx", "charge", "cand", "supp", F.round("loo", 3).alias("loo"))


@query(f"select supp, count(*) as n, round(avg(score), 6) as mean, round(case when count(*) < 2 then 1.0 else greatest(stddev_pop(score), 1e-6) end, 6) as dev from ({_PSM}) group by supp")
def null_zscore(spark, sf_dir):
    return topn.null_stats(psms(spark, sf_dir), ["supp"]).select("supp", "n", F.round("mean", 6).alias("mean"), F.round("dev", 6).alias("dev"))


_TDC = """with d as (select doc_id, n_chars as score, toxic = 1 as decoy from documents join labels using (doc_id)),
  b as (select score, sum(case when decoy then 1 else 0 end) as d, sum(case when decoy then 0 else 1 end) as t from d group by 1),
  r as (select score, sum(d) over w / greatest(sum(t) over w, 1) as rate from b window w as (order by score desc rows unbounded preceding)),
  q as (select score, least(1.0, min(rate) over (order by score desc rows between current row and unbounded following)) as q from r)"""


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("n_chars").alias("score"), (F.col("toxic") == 1).alias("is_decoy"))


@query(_TDC + " select doc_id, decoy as is_decoy, round(q, 9) as q from d join q using (score)")
def tdc_qvalues(spark, sf_dir):
    return fdr.q_values(_labelled(spark, sf_dir), "score", "is_decoy").select("doc_id", "is_decoy", F.round("q", 9).alias("q"))


@query(_TDC + " select cast(f as double) as fdr, count(case when not decoy and q <= f then 1 end) as accepted from d join q using (score) cross join (select cast(unnest([0.01, 0.05, 0.1, 0.2]) as double) as f) group by f")
def accepted_at_fdr(spark, sf_dir):
    q = fdr.q_values(_labelled(spark, sf_dir), "score", "is_decoy")
    rates = F.explode(F.array(*map(F.lit, (0.01, 0.05, 0.1, 0.2))))
    return q.select("*", rates.alias("fdr")).groupBy("fdr").agg(F.count(F.when(~F.col("is_decoy") & (F.col("q") <= F.col("fdr")), 1)).alias("accepted"))


@query("""with m as (select median(value) as m from events), a as (select m, median(abs(value - m)) as mad from events, m group by m)
  select round(m, 6) as median, round(mad, 6) as mad, round(mad * 1.4826, 6) as sigma, round(least(20.0, greatest(2.0, mad * 1.4826 * 3.0 + 0.5)), 6) as tight from a""")
def median_mad_sigma(spark, sf_dir):
    out = fdr.robust_spread(table(spark, sf_dir, "events").select("value"), "value")
    return out.select(F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), F.round("sigma", 6).alias("sigma"), F.round(fdr.tightened_ppm(20.0, F.col("sigma")), 6).alias("tight"))


@query("select o_orderkey from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as n from orders) where n % 10 = 0 and n < 5000")
def systematic_sample(spark, sf_dir):
    return fdr.systematic_sample(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"]).select("o_orderkey")


@query("""select user_id, event_id, ms1 from (select user_id, event_id, event_type, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as ms1 from events) where event_type <> 'click'""")
def ms1_link(spark, sf_dir):
    from ..sources.mzml import with_ms1

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("spec_file"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "click", 1).otherwise(2).alias("ms_level"), "event_id", F.col("user_id"))
    return with_ms1(e).select("user_id", "event_id", F.col("ms1_seq.event_id").alias("ms1"))


_PEAKS = "select vec_id, i, 100 + 10.0 * i as mz, abs(embedding[i + 1]) as inten from embeddings, unnest(range(0, len(embedding))) as t(i)"


def peak_lists(spark, sf_dir):
    """Embeddings as spectra."""
    e = table(spark, sf_dir, "embeddings")
    peaks = F.transform("embedding", lambda x, i: F.struct((100 + 10.0 * i).alias("mz"), F.abs(x).cast("float").alias("intensity")))
    return e.select(F.col("vec_id").alias("spectrum_idx"), F.lit(600.0).alias("precursor_mz"), peaks.alias("peaks"), "label")


def _per_peak(df, *columns):
    out = df.select(F.col("spectrum_idx").alias("vec_id"), F.posexplode(F.arrays_zip(*columns)).alias("i", "p"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), *[f"p.{c}" for c in columns])


@query(f"select vec_id, i, cast(row_number() over (partition by vec_id order by inten desc, mz) as integer) as rank from ({_PEAKS})")
def peak_rank(spark, sf_dir):
    return _per_peak(prepared(peak_lists(spark, sf_dir), tiny_model()), "rank")


@query(f"""select vec_id, i, cast(row_number() over (partition by vec_id order by inten desc, mz) as integer) as rank
  from (select *, row_number() over (partition by vec_id, floor(mz / 100) order by inten desc, mz) as n from ({_PEAKS})) where n <= 3""")
def windowed_topk_peaks(spark, sf_dir):
    return _per_peak(prepared(peak_lists(spark, sf_dir), tiny_model(), window=(100.0, 3)), "rank").where("rank > 0")


@query(f"select vec_id, i, count(*) over (partition by vec_id order by mz range between 50 preceding and 50 following) / 100.0 as density from ({_PEAKS})")
def local_density(spark, sf_dir):
    return _per_peak(prepared(peak_lists(spark, sf_dir), tiny_model()), "density")


# peaks within 5 Da of what is left of the charge-1 precursor go; the width of a chance bin is twice the model's tolerance
@query(f"""with k as (select * from ({_PEAKS}) where abs(mz - 598.99272351) > 5)
  select vec_id, round(sum(cast(inten as double)), 4) as total_intensity, round(count(*) / (1197.98544702 / 40), 5) as peak_chance from k group by vec_id""")
def peak_statistics(spark, sf_dir):
    from dataclasses import replace

    model = replace(tiny_model(), precursor_offsets={2: [(1, -600.0, Tolerance(5.0, "Da"), 1.0)]})
    out = prepared(peak_lists(spark, sf_dir), model)
    return out.select(F.col("spectrum_idx").alias("vec_id"), F.round("total_intensity", 4).alias("total_intensity"), F.round("peak_chance", 5).alias("peak_chance"))


@query(f"""with t as (select vec_id, label, 100 + 37.0 * label + 55.0 as target from embeddings)
  select t.vec_id, arg_max(p.i, struct_pack(a := p.inten, b := -p.mz)) as i from t join ({_PEAKS}) p on t.vec_id = p.vec_id and abs(p.mz - target) <= 30 group by t.vec_id""")
def base_peak_match(spark, sf_dir):
    e = peak_lists(spark, sf_dir).withColumn("targets", F.array(100 + 37.0 * F.col("label") + 55.0))
    out = strongest_peaks(e, tiny_model(), 30.0).select(F.col("spectrum_idx").alias("vec_id"), F.col("hits")[0].cast("long").alias("i"))
    return out.where("i >= 0")


@query("""with f as (select vec_id, i, embedding[i + 1] > 0 as up from embeddings, unnest(range(0, len(embedding))) as t(i)),
  g as (select vec_id, i - row_number() over (partition by vec_id, up order by i) as g, up from f), r as (select vec_id, g, count(*) as n from g where up group by 1, 2)
  select e.vec_id, cast(coalesce(max(n), 0) as integer) as run from embeddings e left join r using (vec_id) group by 1""")
def longest_run(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", topn.longest_run(F.transform("embedding", lambda x: x > 0)).alias("run"))


@query("""with c as (select a.vec_id, b.label, list_sum(list_transform(list_zip(a.embedding, b.c), lambda p: cast(p[1] as double) * p[2])) as dot, sqrt(list_sum(list_transform(a.embedding, lambda x: cast(x as double) * x))) as na, sqrt(list_sum(list_transform(b.c, lambda x: x * x))) as nb
  from embeddings a join (select label, list(v order by i) as c from (select label, i, round(avg(cast(embedding[i + 1] as double)), 6) as v from embeddings, unnest(range(0, 64)) as t(i) group by 1, 2) group by 1) b on a.label = b.label)
  select vec_id, label, round(least(greatest(case when na * nb = 0 then 0 else dot / (na * nb) end, 0), 1), 6) as cosine from c""")
def cosine_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("v"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c"))
    wide = F.transform("embedding", lambda x: x.cast("double"))
    return e.join(mean, "label").select("vec_id", "label", F.round(chem.cosine(wide, F.col("c")), 6).alias("cosine"))


@query("""with r as (select p_partkey, p_retailprice * 4.76e-4 as l from part), p as (select p_partkey, list_transform(range(0, 4), lambda k: exp(-l) * pow(l, k) / factorial(cast(k as integer))) as v from r),
  n as (select p_partkey, list_transform(v, lambda x: x / list_sum(v)) as t from p) select p_partkey, round(t[1], 9) as t0, round(t[2], 9) as t1, round(t[3], 9) as t2, round(t[4], 9) as t3,
  round(list_sum(list_transform(t, lambda x: 0.25 * ln(0.25 / greatest(x, 1e-9)))), 8) as kl from n""")
def poisson_envelope_kl(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    t = part.select("p_partkey", chem.averagine(F.col("p_retailprice"), 4).alias("t"))
    # four equal peaks where the isotopes of charge 2 stand
    peaks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((500 + k * (chem.ISOTOPE / 2)).alias("mz"), F.lit(1.0).alias("intensity")))
    kl = envelopes(part.select(F.col("p_partkey").alias("id"), peaks.alias("ms1_peaks"), F.lit(500.0).alias("mono"), F.lit(2).alias("charge"), F.col("p_retailprice").alias("mass")), 0.01)
    out = t.join(kl.withColumnRenamed("id", "p_partkey"), "p_partkey")
    return out.select("p_partkey", *[F.round(F.col("t")[i], 9).alias(f"t{i}") for i in range(4)], F.round("kl", 8).alias("kl"))



_COUNTS = "select l_returnflag as flag, l_linestatus as status, l_linenumber as line, cast(round(l_discount * 100) as integer) as bin, l_suppkey % 3 as source from lineitem"


def counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.lit("rank").alias("kind"), F.ascii("l_returnflag").alias("charge"), F.col("l_linenumber").alias("seg"), F.lit(0.0).cast("float").alias("mass"), F.col("l_linestatus").alias("ion_kind"), F.lit(1).alias("ion_charge"), F.lit(0.0).cast("float").alias("ion_offset"), F.round(F.col("l_discount") * 100).cast("int").alias("bin"), F.lit(1).cast("long").alias("n"), (F.col("l_suppkey") % 3).alias("source_id"))


@query(f"select ascii(flag) as charge, line as seg, status as ion_kind, bin, count(*) as n from ({_COUNTS}) group by all")
def count_merge(spark, sf_dir):
    return train.merge(counts(spark, sf_dir).drop("source_id")).select("charge", "seg", "ion_kind", "bin", "n")


@query(f"""with s as (select flag, line, status, bin, source, count(*) as n from ({_COUNTS}) group by all)
  select ascii(flag) as charge, line as seg, status as ion_kind, bin, cast(sum(round(n * (0.5 + source * 0.25))) as bigint) as n from s group by all having sum(round(n * (0.5 + source * 0.25))) > 0""")
def weighted_counts(spark, sf_dir):
    c = counts(spark, sf_dir).groupBy(*train.COUNT_KEYS, "source_id").agg(F.sum("n").alias("n"))
    w = spark.createDataFrame([(i, 0.5 + i * 0.25) for i in range(3)], "source_id long, weight double")
    return train.combined(c, w).select("charge", "seg", "ion_kind", "bin", "n")


@query(f"""select case when grouping(flag) = 1 then -1 else ascii(flag) end as charge, case when grouping(line) = 1 then -1 else line end as seg, status as ion_kind, bin, count(*) as n
  from ({_COUNTS}) group by grouping sets ((flag, line, status, bin), (flag, status, bin), (status, bin))""")
def laplace_backoff(spark, sf_dir):
    out = train.backoff_levels(counts(spark, sf_dir))
    return out.select(F.when(F.col("level") == 2, -1).otherwise(F.col("charge")).alias("charge"), F.when(F.col("level") > 0, -1).otherwise(F.col("seg")).alias("seg"), "ion_kind", "bin", "n")


@query("""select o_orderkey, cast(round(cast(cast(o_totalprice as float) * pow(2.0, -greatest(date_diff('day', cast(o_orderdate as date), date '2002-01-01'), 0) / 365.0) as float) / 10) as bigint) as weight from orders""")
def decay_weights(spark, sf_dir):
    from ..operators.store import decayed

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("date"), F.col("o_totalprice").cast("float").alias("weight"))
    return decayed(o, 365.0, "2002-01-01").select("o_orderkey", F.round(F.col("weight") / 10).cast("long").alias("weight"))


_INTENSITY = "select l_returnflag as ion_type, chr(65 + cast(l_partkey % 5 as integer)) as flank_n, chr(65 + cast(l_suppkey % 5 as integer)) as flank_c, cast(l_linenumber as integer) as pos_bin, 2 as charge, 'unknown' as nce_bin, l_discount as x from lineitem"


def _intensity_partial(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    letter = lambda c: F.char((65 + F.col(c) % 5).cast("int"))
    return li.select(F.col("l_returnflag").alias("ion_type"), letter("l_partkey").alias("flank_n"), letter("l_suppkey").alias("flank_c"), F.col("l_linenumber").alias("pos_bin"), F.lit(2).alias("charge"), F.lit("unknown").alias("nce_bin"), F.lit(1).cast("long").alias("count"), F.col("l_discount").alias("sum_log_rel"), (F.col("l_discount") * F.col("l_discount")).alias("sum_log_rel_sq"))


@query(f"select ion_type, flank_n, flank_c, pos_bin, count(*) as n, round(avg(x), 6) as mean, round(var_pop(x), 6) as var from ({_INTENSITY}) group by all")
def intensity_merge(spark, sf_dir):
    m = intensity.merged(_intensity_partial(spark, sf_dir))
    return m.select("ion_type", "flank_n", "flank_c", "pos_bin", F.col("count").alias("n"), F.round("mean_log_rel", 6).alias("mean"), F.round("var_log_rel", 6).alias("var"))


@query(f"""with m as (select ion_type, flank_n, flank_c, pos_bin, count(*) as n, avg(x) as mean from ({_INTENSITY}) group by all),
  b as (select ion_type, '*' as flank_n, '*' as flank_c, pos_bin, count(*) as n, avg(x) as mean from ({_INTENSITY}) group by all), g as (select avg(x) as mean from ({_INTENSITY})),
  w as (select distinct ion_type, flank_n, flank_c, pos_bin from m union all select distinct ion_type, 'Z', 'Z', pos_bin from m)
  select w.ion_type, w.flank_n, w.flank_c, w.pos_bin, round(coalesce(case when m.n >= 60 then m.mean end, case when b.n >= 60 then b.mean end, g.mean), 6) as mean
  from w left join m using (ion_type, flank_n, flank_c, pos_bin) left join b on w.ion_type = b.ion_type and w.pos_bin = b.pos_bin cross join g""")
def intensity_backoff(spark, sf_dir):
    p = _intensity_partial(spark, sf_dir)
    m = intensity.merged(p)
    star = intensity.merged(p.withColumns({"flank_n": F.lit("*"), "flank_c": F.lit("*")}))
    some = m.select(*intensity.KEYS)
    wanted = some.unionByName(some.withColumns({"flank_n": F.lit("Z"), "flank_c": F.lit("Z")}).distinct())
    # both levels hold all rows once, so the mean over all is that of either
    out = intensity.looked_up(wanted, m.unionByName(star), 60)
    return out.select("ion_type", "flank_n", "flank_c", "pos_bin", F.round("mean_log_rel", 6).alias("mean"))


@query("""with m as (select lpad(cast(p_partkey as varchar), 9, '0') as id, list_sort(list_distinct(string_split(lower(p_name), ' '))) as c from part where p_brand = 'Brand#2'),
  w as (select id, c, case when c = ['ring', 'small'] then 1 when len(c) > 0 and len(c) < 2 and len(list_filter(c, lambda x: x not in ('ring', 'small'))) = 0 then 2 end as step from m)
  select coalesce((select id from w where step is not null order by step, case when step = 2 then -len(c) else 0 end, id limit 1), 'generic') as model_id""")
def model_selection_ladder(spark, sf_dir):
    from ..operators.model import select_model

    part = table(spark, sf_dir, "part")
    store = part.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("model_id"), F.lit("HCD").alias("activation"), F.col("p_brand").alias("instrument"), F.lit("Trypsin").alias("enzyme"), F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("experiment_class"))
    return spark.createDataFrame([(select_model(store, "HCD", "Brand#2", "Trypsin", {"small", "ring"}, None, "generic"),)], "model_id string")


@query("""with m as (select p_partkey, p_retailprice / 10 as mass, substr('KSGT', cast(p_partkey % 4 as integer) + 1, 1) as r from part),
  c as (select unnest(['phospho', 'tmt', 'itraq', 'itraq', 'acetyl', 'ubiquitin']) as name, unnest([79.96633, 229.1629, 144.1021, 304.2054, 42.0106, 114.0429]) as sig, unnest(['STY', 'K', 'K', 'K', 'K', 'K']) as sites)
  select p_partkey, coalesce(string_agg(distinct name, '+' order by name), 'standard') as class from m left join c on abs(mass - sig) <= 5 and contains(sites, r) group by p_partkey""")
def class_inference(spark, sf_dir):
    mod = F.struct((F.col("p_retailprice") / 10).alias("mass"), F.substring(F.lit("KSGT"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("residue"))
    return table(spark, sf_dir, "part").select("p_partkey", names.inferred_class(F.array(mod), 5.0).alias("class"))


@query("""select l_orderkey, string_agg(s, '|' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as proteins from (
  select l.*, coalesce(s_name, 'PROT_' || l_suppkey) as s from lineitem l left join (select * from supplier where s_suppkey % 7 <> 0) on s_suppkey = l_suppkey) group by l_orderkey""")
def protein_multi_map(spark, sf_dir):
    from .search import accessions

    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    psms = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("spectrum_idx")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    psms = psms.select("spectrum_idx", F.lit(2).alias("charge"), F.lit(0).cast("long").alias("cand_idx"), F.transform("r", lambda x: x["l_suppkey"]).alias("candidate_idxs"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("protein_index"), F.col("s_name").alias("accession"))
    cands = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cand_idx")).distinct().withColumn("protein_index", F.col("cand_idx"))
    return accessions(psms, cands, s.where("protein_index % 7 <> 0")).select(F.col("spectrum_idx").alias("l_orderkey"), F.array_join("proteins", "|").alias("proteins"))



@query("""with p as (select l_orderkey, bool_and(l_returnflag = 'A') as ent from lineitem group by 1)
  select count(*) as n, count(case when ent then 1 end) as entrapped, 2.0 * count(case when ent then 1 end) / count(*) as fdp from p""")
def entrapment_fdp(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "A", "ENT_A").otherwise("P")).alias("proteins"))
    return fdr.entrapment(p)


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_discount = 0 then '0' else printf('%.6g', l_extendedprice * l_discount / 1e4) end as shown from lineitem")
def report_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem")
    return o.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.report_number(F.col("l_extendedprice") * F.col("l_discount") / 1e4).alias("shown"))


@query("""with p as (select p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) as s from part)
  select p_partkey, cast(s similar to '.*[KR]' as integer) as enz_c, cast(len(list_filter(range(1, length(s)), lambda i: substr(s, i, 1) in ('K', 'R') and substr(s, i + 1, 1) <> 'P')) as integer) as boundaries from p""")
def enzymatic_ends(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.regexp_replace("p_name", "[^A-Za-z]", "")).alias("s"))
    end = F.right("s", F.lit(1))
    return part.select("p_partkey", F.when(chem.enzymatic_boundary(end, F.lit("A"), chem.TRYPSIN), 1).otherwise(0).alias("enz_c"), chem.internal_boundaries(F.col("s"), chem.TRYPSIN).alias("boundaries"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as proteins with decoys, digested and matched by mass to orders as precursors."""
    p = doc_proteins(spark, sf_dir).withColumn("protein_index", F.col("protein_index") * 2)
    decoys = p.withColumns({"protein_index": F.col("protein_index") + 1, "accession": names.decoy_accession(F.col("accession")), "sequence": F.reverse("sequence"), "is_decoy": F.lit(True)})
    o = table(spark, sf_dir, "orders")
    spectra = o.select(F.col("o_orderkey").alias("spectrum_idx"), (F.col("o_totalprice") / 200 + 300).alias("precursor_mz"), F.lit(None).cast("int").alias("precursor_charge"), F.array(F.lit(0)).alias("peaks"))
    out = match.digested_matches(spectra, p.unionByName(decoys), MatchOptions(min_peaks=1), keep=("sequence", "is_decoy"))
    return out.select("cand_idx", *[c for c in out.columns if c != "cand_idx"])


@query(None)
def search_candidates(spark, sf_dir):
    return flagship(spark, sf_dir)


from . import queries  # noqa: E402, F401  registers more of them
