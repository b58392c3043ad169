"""Registered queries: each takes (spark, sf_dir) and returns a lazy DataFrame over the driver tables.

Query parameters (model shapes, k, thresholds) are fixed here; views come from
``seqpool.plans.views``.  Column names match the SQL in ``seqpool.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpool.operators import pooling as P
from seqpool.operators.interpolate import interpolate
from seqpool.plans import params as PR
from seqpool.plans import views as V
from seqpool.session import materialise

# Fixed query shapes.
DIM = 64          # width of the driver's embedding vectors
SWE_L = 8         # slices in the checked SWE queries
SWE_M = 16        # reference points in the checked SWE queries
TOPK = 5

WITHOUT_SQL: set[str] = set()  # registered queries that SQL cannot express
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def swe_params(n_slices: int = SWE_L, n_ref: int = SWE_M):
    return PR.slicers(n_slices, DIM), PR.permuted_reference(n_ref, n_slices), PR.ref_weights(n_ref)


# --------------------------------------------------------------------------------------- pooling


@query
def pool_swe(spark, sf):
    """The flagship: one row per token with its projections, one shuffle by the set; large sets are ranked over ranges."""
    th, ref, w = swe_params()
    out = P.pool_swe(V.tokens(spark, sf), th, ref, w, layout="sorted", project_with="arrow")
    return out.select("seq_id", "slice", r6("value").alias("value"))


@query
def pool_swe_arrays(spark, sf):
    th, ref, w = swe_params()
    out = P.pool_swe(V.tokens(spark, sf), th, ref, w, layout="arrays")
    return out.select("seq_id", "slice", r6("value").alias("value"))


@query
def pool_swe_window(spark, sf):
    th, ref, w = swe_params()
    out = P.pool_swe(V.tokens(spark, sf), th, ref, w, layout="window")
    return out.select("seq_id", "slice", r6("value").alias("value"))


@query
def pool_avg(spark, sf):
    return P.pool_avg(V.tokens(spark, sf)).select("seq_id", "dim", r6("value").alias("value"))


@query
def pool_max(spark, sf):
    return P.pool_max(V.tokens(spark, sf)).select("seq_id", "dim", r6("value").alias("value"))


@query
def pool_topk(spark, sf):
    return P.pool_topk(V.tokens(spark, sf), k=TOPK).select("seq_id", "dim", r6("value").alias("value"))


@query
def swe_displacement(spark, sf):
    th, ref, _ = swe_params()
    out = P.swe_displacement(V.tokens(spark, sf), th, ref)
    return out.select("seq_id", "slice", "m", r6("value").alias("value"))


@query
def slice_rank(spark, sf):
    th, _, _ = swe_params()
    out = P.slice_rank(V.tokens(spark, sf), th)
    return out.select("seq_id", "pos", "slice", "rank", r6("p").alias("p"))


@query
def slice_end_slope(spark, sf):
    th, _, _ = swe_params()
    out = P.slice_end_slope(V.tokens(spark, sf), th)
    return out.select("seq_id", "slice", r6("gap").alias("gap"), r6("slope").alias("slope"))


@query
def sorted_slices(spark, sf):
    th, _, _ = swe_params()
    s = P.sorted_slices(P.slice_projections(V.tokens(spark, sf), th))
    return s.select("seq_id", "slice", F.posexplode("v").alias("idx", "p")).select(
        "seq_id", "slice", F.col("idx").cast("bigint").alias("idx"), r6("p").alias("p"))


# --------------------------------------------------------------------------------------- metrics

from seqpool.operators import metrics as M  # noqa: E402
from seqpool.functions.vec import matvec  # noqa: E402

N_CLASSES = 10


def _class_logits(spark, sf):
    """T4 on the driver's labelled vectors: logits = W . embedding, W = projector(10, 64)."""
    e = V.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id"), matvec(PR.projector(N_CLASSES, DIM), "embedding").alias("logits"),
                    F.col("label").cast("bigint").alias("label"))


def _mlab_weights(spark, sf):
    """A10 on the multi-label view: weight = #proteins / #positive targets of the label."""
    ml = V.mlab(spark, sf)
    n = ml.select(F.countDistinct("protein")).scalar()
    freq = ml.groupBy("label").agg(F.sum("target").alias("freq"))
    return freq.select("label", F.try_divide(n.cast("double"), F.col("freq").cast("double")).alias("weight"))


@query
def metric_average_precision(spark, sf):
    return M.average_precision(V.preds(spark, sf)).select(r6("average_precision").alias("average_precision"))


@query
def metric_auroc(spark, sf):
    return M.auroc(V.preds(spark, sf)).select(r6("auroc").alias("auroc"))


@query
def pr_roc_curve(spark, sf):
    c = M.pr_roc_curve(V.preds(spark, sf))
    return c.select(r6("score").alias("score"), F.col("tp").cast("bigint").alias("tp"),
                    F.col("fp").cast("bigint").alias("fp"), r6("precision").alias("precision"),
                    r6("recall").alias("recall"), r6("fpr").alias("fpr"))


@query
def metric_binary_confusion(spark, sf):
    c = M.binary_confusion(V.preds(spark, sf))
    return c.select("tp", "fp", "fn", "tn", *[r6(x).alias(x) for x in
                    ("accuracy", "precision", "recall", "specificity", "f1", "mcc")])


@query
def metric_regression(spark, sf):
    return M.regression(V.reg(spark, sf)).select(r6("mse").alias("mse"), r6("pearson").alias("pearson"))


@query
def metric_micro_auprc(spark, sf):
    return M.average_precision(V.mlab(spark, sf), "score", "target").select(
        r6("average_precision").alias("micro_auprc"))


@query
def metric_micro_auroc(spark, sf):
    return M.auroc(V.mlab(spark, sf), "score", "target").select(r6("auroc").alias("micro_auroc"))


@query
def metric_f1_max(spark, sf):
    return M.f1_max(V.mlab(spark, sf)).select(r6("f1_max").alias("f1_max"))


IDENTITY_LEVELS = (95, 50, 30)


def line_preds(spark, sf):
    """A score per line with many distinct values; some scores and some groups are NULL."""
    li = V.table(spark, sf, "lineitem")
    score = F.col("l_extendedprice") / (F.col("l_quantity") * 2500.0)
    return li.select(
        F.col("l_orderkey").alias("protein"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_linenumber") < 7, score).alias("score"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("label"),
        F.when(F.col("l_linestatus") == "O", F.month("l_shipdate").cast("bigint")).alias("grp"))


@query
def line_average_precision(spark, sf):
    return M.average_precision(line_preds(spark, sf)).select(r6("average_precision").alias("average_precision"))


@query
def line_auroc_by_group(spark, sf):
    return M.auroc(line_preds(spark, sf), group=["grp"]).select("grp", r6("auroc").alias("auroc"))


@query
def line_f1_max(spark, sf):
    return M.f1_max(line_preds(spark, sf), target="label").select(r6("f1_max").alias("f1_max"))


def _by_identity(spark, sf):
    ml = V.mlab(spark, sf)
    mem = V.members(spark, sf)
    flags = F.array(*[F.struct(F.lit(p).cast("bigint").alias("percent"), F.col(f"p{p}").alias("flag"))
                      for p in IDENTITY_LEVELS])
    long = mem.select("protein", F.explode(flags).alias("m")).where(F.col("m.flag") == "1").select(
        "protein", F.col("m.percent").alias("percent"))
    return ml.withColumn("protein", F.col("protein").cast("string")).join(long, "protein")


@query
def metric_by_identity(spark, sf):
    x = materialise(_by_identity(spark, sf).select("protein", "percent", "score", "target"), "by-identity")
    ap = M.average_precision(x, "score", "target", group=["percent"])
    fm = M.f1_max(x, group=["percent"])
    return ap.join(fm, "percent").select("percent", r6("average_precision").alias("micro_auprc"),
                                         r6("f1_max").alias("f1_max"))


@query
def metric_multiclass_accuracy(spark, sf):
    return M.multiclass_accuracy(_class_logits(spark, sf)).select(r6("accuracy").alias("accuracy"))


@query
def loss_cross_entropy(spark, sf):
    return M.loss_cross_entropy(_class_logits(spark, sf)).select(r6("cross_entropy").alias("cross_entropy"))


@query
def loss_bce(spark, sf):
    return M.loss_bce(V.preds(spark, sf)).select(r6("bce").alias("bce"))


@query
def loss_weighted_bce(spark, sf):
    out = M.loss_weighted_bce(V.mlab(spark, sf), _mlab_weights(spark, sf))
    return out.select(r6("weighted_bce").alias("weighted_bce"))


@query
def epoch_timing(spark, sf):
    ep = V.epochs(spark, sf)
    secs = (F.unix_micros(F.col("t_end").cast("timestamp")) - F.unix_micros(F.col("t_start").cast("timestamp"))) / 1e6
    return ep.select("run_id", "epoch", r6(secs).alias("seconds"))


# --------------------------------------------------------------------------------------- preparation

from seqpool.operators import joins as J  # noqa: E402
from seqpool.operators import labels as LB  # noqa: E402
from seqpool.operators import prep as PP  # noqa: E402
from seqpool.functions import arrays as AR  # noqa: E402
from seqpool.functions import text as TX  # noqa: E402
from seqpool.functions.vec import vsum  # noqa: E402
from seqpool.sources import text as ST  # noqa: E402

BATCH = 32
SEED = 12345


def _docs(spark, sf):
    return V.table(spark, sf, "documents")


def _split_rows(spark, sf):
    s = V.splits(spark, sf)
    return s.select("doc_id", "target", PP.nullsafe_split(s).alias("split"))


@query
def project_pair_columns(spark, sf):
    return PP.project_pair_columns(V.pairs(spark, sf), "drug_key", "target_key", "label", extra=["row_id"])


@query
def nullsafe_split(spark, sf):
    return _split_rows(spark, sf).select("doc_id", "split")


@query
def normalize_sequence(spark, sf):
    return _docs(spark, sf).select("doc_id", PP.normalize_sequence(TX.upper_ascii(F.col("text"))).alias("seq"))


def _positions(res):
    """Derived coordinates per residue: (id, index, index^2 mod 17)."""
    return F.transform(res, lambda r, i: F.array(r.cast("double"), i.cast("double"),
                                                 (i.cast("bigint") * i.cast("bigint") % 17).cast("double")))


def _residues(spark, sf):
    d = _docs(spark, sf).select("doc_id", TX.residue_ids(TX.upper_ascii_batch(F.col("text"))).alias("res"))
    return d.select("doc_id", PP.residue_record(F.col("res"), _positions(F.col("res"))).alias("rec"))


@query
def residue_record(spark, sf):
    """The record of every text's residues, built and summed in the task that reads the text."""
    res = TX.residue_ids(TX.upper_ascii_batch(F.col("text")))
    return _docs(spark, sf).select("doc_id", PP.record_sums(res).alias("sums")).select("doc_id", "sums.*")


@query
def truncate_residues(spark, sf):
    r = _residues(spark, sf).select("doc_id", *PP.truncate_arrays(["rec.residue", "rec.number"]))
    return r.select("doc_id", F.size("residue").cast("bigint").alias("n"), AR.indexed_sum(F.col("residue")).alias("residue_wsum"),
                    AR.int_sum(F.col("number")).alias("number_sum"))


@query
def center_positions(spark, sf):
    """Positions of all residues minus the per-protein mean (truncation comes later)."""
    d = _docs(spark, sf).select("doc_id", TX.residue_ids(TX.upper_ascii_batch(F.col("text"))).alias("res"))
    r = d.where(F.size("res") > 0).select("doc_id", PP.center_positions(_positions(F.col("res"))).alias("c"))
    ss = F.aggregate(F.flatten("c"), F.lit(0.0), lambda a, x: a + x * x)
    return r.select("doc_id", r6(F.sqrt(ss / F.size("c"))).alias("centered_rms"))


@query
def sanitize_key(spark, sf):
    return V.table(spark, sf, "pages").select("page_id", TX.sanitize_key(F.col("url")).alias("key"))


@query
def identity_filter(spark, sf):
    return PP.identity_filter(V.members(spark, sf), 50).select("protein")


@query
def trim_tokens(spark, sf):
    e = V.table(spark, sf, "embeddings")
    a = e.select("vec_id", F.lit("drop_ends").alias("variant"), F.posexplode(PP.trim_first_last(F.col("embedding"))))
    b = e.select("vec_id", F.lit("drop_last_two").alias("variant"), F.posexplode(PP.trim_last_two(F.col("embedding"))))
    return a.unionByName(b).select("vec_id", "variant", F.col("pos").cast("bigint").alias("idx"),
                                   r6(F.col("col").cast("double")).alias("value"))


@query
def zero_vector_fallback(spark, sf):
    seq = TX.upper_ascii(F.col("text"))
    fp = TX.dense_bits(TX.hashed_fingerprint(seq, 2048, 2), 2048)
    valid = F.length(seq) >= 3
    d = _docs(spark, sf).select("doc_id", PP.zero_fallback(fp, valid, 2048).alias("v"), (~valid).alias("rejected"))
    return d.select("doc_id", vsum("v").cast("bigint").alias("n_set"), "rejected")


@query
def hashed_fingerprint(spark, sf):
    b = TX.ngram_buckets(TX.upper_ascii(F.col("text")), 3, 2048)
    return _docs(spark, sf).select("doc_id", F.size(b).cast("bigint").alias("n_bits"),
                                   F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bit_sum"))


@query
def char_tokenize(spark, sf):
    ids = TX.char_tokenize(TX.upper_ascii(F.col("text")))
    return _docs(spark, sf).select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"),
                                   AR.int_sum(ids).alias("id_sum"),
                                   AR.indexed_sum(ids).alias("id_wsum"))


@query
def residue_ids(spark, sf):
    ids = TX.residue_ids(TX.upper_ascii_batch(F.col("text")))
    return _docs(spark, sf).select("doc_id", F.size(ids).cast("bigint").alias("n"),
                                   AR.int_sum(ids).alias("id_sum"),
                                   AR.indexed_sum(ids).alias("id_wsum"))


@query
def eval_cadence(spark, sf):
    return PP.eval_cadence(V.epochs(spark, sf), 5).select("run_id", "epoch", r6("v").alias("v"))


@query
def pos_neg_union(spark, sf):
    e = V.edges(spark, sf).select("row_id", "p0", "p1", "label")
    return PP.pos_neg_union(e.where("label = 1").drop("label"), e.where("label = 0").drop("label"))


@query
def distinct_keys(spark, sf):
    e = V.edges(spark, sf)
    return PP.distinct_keys([(e, "p0"), (e, "p1")], out="key")


@query
def split_union(spark, sf):
    """Sizes of the three splits' tables once united."""
    return PP.split_sizes(_united(spark, sf).select("split", F.col("p0").alias("key")), "split", "key")


@query
def split_union_rows(spark, sf):
    """The rows of the three splits' tables."""
    return _united(spark, sf).select("row_id", "p0", "p1", "label", "split")


def _united(spark, sf):
    """The edges, written to a folder per split, and the splits' tables united again."""
    edges, path = V.edges(spark, sf), shared_scratch(spark, "split-edges")
    edges.write.partitionBy("split").parquet(path)
    rows = spark.read.schema(edges.schema).parquet(path)
    return PP.union_splits({s: rows.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")})


@query
def split_sizes(spark, sf):
    return PP.split_sizes(_split_rows(spark, sf).where(F.col("split").isNotNull()), "split", "target")


@query
def assign_batches(spark, sf):
    return PP.assign_batches(V.pairs(spark, sf).select("row_id"), "row_id", BATCH, SEED)


@query
def seeded_shuffle(spark, sf):
    return PP.seeded_shuffle(_docs(spark, sf).select("doc_id"), "doc_id", SEED)


SENTINEL = 20.0


def _padded_slots(spark, sf):
    """(batch_id, seq_id, pos, vec) of batches padded with sentinel vectors."""
    t = V.tokens(spark, sf)
    seqs = t.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    b = PP.assign_batches(seqs, "seq_id", 4, SEED)
    longest = b.groupBy("batch_id").agg(F.max("n").alias("pad_len"))
    slots = b.join(longest, "batch_id").select(
        "batch_id", "seq_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pad_len") - 1)).alias("pos"))
    filled = slots.join(t, ["seq_id", "pos"], "left")
    vec = F.coalesce(F.col("vec").cast("array<double>"), F.array_repeat(F.lit(SENTINEL), DIM))
    return filled.select("batch_id", "seq_id", "pos", vec.alias("vec"))


def _padded_batches(spark, sf):
    x = _padded_slots(spark, sf).select("batch_id", "seq_id", "pos", F.posexplode("vec").alias("dim", "value"))
    return x.withColumn("dim", F.col("dim").cast("bigint"))


@query
def pad_batch(spark, sf):
    """W2 + H9: token vectors of a sequence, padded with the sentinel to the longest of its batch (B=4, seeded order).

    A row per (sequence, position, dimension) of the padded batch."""
    x = _padded_batches(spark, sf)
    return x.select("batch_id", "seq_id", "pos", "dim", r6("value").alias("value"))


@query
def sentinel_mask(spark, sf):
    """Valid positions of the padded batch, by all dimensions and by the first one alone."""
    x = _padded_batches(spark, sf)
    off = (F.col("value") != F.lit(SENTINEL)).cast("bigint")
    return x.groupBy("batch_id", "seq_id", "pos").agg(
        F.max(off).alias("valid_any"), F.max(F.when(F.col("dim") == 0, off)).alias("valid_first"))


@query
def first_appearance_index(spark, sf):
    tr = _split_rows(spark, sf).where(F.col("split") == "train")
    return PP.first_appearance_index(tr, "target", "doc_id")


@query
def label_map_join(spark, sf):
    rows = _split_rows(spark, sf)
    idx = PP.first_appearance_index(rows.where(F.col("split") == "train"), "target", "doc_id")
    return J.label_map(rows, idx, "target").select("doc_id", "split", "target", "idx")


@query
def group_holdout_split(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", "source", PP.group_holdout_split(d, "doc_id", "source", 0.2, SEED).alias("part"))


# --------------------------------------------------------------------------------------- joins


@query
def pair_feature_join(spark, sf):
    x = J.pair_features(V.pairs(spark, sf), V.key_features(spark, sf, V.pair_keys(spark, sf)))
    return x.select("row_id", "drug_key", "target_key", "label",
                    r6(vsum("drug_vec")).alias("drug_sum"), r6(vsum("target_vec")).alias("target_sum"))


@query
def entity_feature_join(spark, sf):
    s = V.splits(spark, sf).select("doc_id", "target")
    x = J.lookup(s, V.key_features(spark, sf, V.entity_keys(spark, sf)), "doc_id", out="vec")
    return x.select("doc_id", "target", r6(vsum("vec")).alias("vec_sum"))


@query
def unresolved_pair_keys(spark, sf):
    """Quarantine of the pair lookup over the given vectors only: drug keys without one, and their pairs."""
    return J.unresolved(V.pairs(spark, sf), V.features(spark, sf), "drug_key")


@query
def edge_feature_selfjoin(spark, sf):
    x = J.edge_features(V.edges(spark, sf).drop("split"), V.key_features(spark, sf, V.edge_keys(spark, sf)))
    return x.select("row_id", "label", r6(vsum("p0_vec")).alias("p0_sum"), r6(vsum("p1_vec")).alias("p1_sum"))


def _resolved(spark, sf):
    e = V.edges(spark, sf)
    ids = PP.distinct_keys([(e, "p0"), (e, "p1")], out="acc")
    prim = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("acc"), F.col("text").alias("seq"))
    fb = V.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("acc"), F.col("url").alias("seq"))
    return J.resolve(ids, prim, fb)


@query
def resolve_accession(spark, sf):
    r = _resolved(spark, sf)
    return r.select("acc", "source", F.length("seq").cast("bigint").alias("seq_len"))


@query
def unresolved_accession(spark, sf):
    return _resolved(spark, sf).where(F.col("seq").isNull()).select("acc")


@query
def membership_semi(spark, sf):
    ml = V.mlab(spark, sf).withColumn("protein", F.col("protein").cast("string"))
    keep = PP.identity_filter(V.members(spark, sf), 50)
    return J.semi(ml, keep, "protein").select("protein", "label")


@query
def missing_keys_anti(spark, sf):
    keys = V.pairs(spark, sf).select(F.col("drug_key").alias("key")).distinct()
    return J.anti(keys, V.features(spark, sf), "key").select(F.col("key").alias("drug_key"))


def _annotations(spark, sf, with_errors=True):
    return ST.parse_annotation_lines(V.annot_lines(spark, sf, with_errors))


def _vocab_index(spark, sf):
    return ST.vocabulary_index(V.annot_vocabulary(spark, sf))


@query
def annotation_scan(spark, sf):
    a = _annotations(spark, sf)
    return a.select("protein", F.posexplode("codes").alias("pos", "code")).select(
        "protein", F.col("pos").cast("bigint").alias("pos"), "code")


@query
def annotation_join(spark, sf):
    good, _ = J.annotation_join(V.annot_proteins(spark, sf), _annotations(spark, sf, False))
    return good.select("protein", F.size("codes").cast("bigint").alias("n_codes"))


@query
def annotation_quarantine(spark, sf):
    _, bad = J.annotation_join(V.annot_proteins(spark, sf), _annotations(spark, sf, False))
    return bad.select("protein")


@query
def code_index_join(spark, sf):
    x = J.code_index(_annotations(spark, sf), _vocab_index(spark, sf))
    return x.select("protein", F.col("pos").cast("bigint").alias("pos"), "code", "idx")


@query
def align_pred_label(spark, sf):
    r = V.reg(spark, sf)
    return J.align(r.select("row_id", "p"), r.select("row_id", "y")).select("row_id", r6("p").alias("p"), r6("y").alias("y"))


@query
def label_frequency(spark, sf):
    return LB.label_frequency(_annotations(spark, sf), _vocab_index(spark, sf))


@query
def class_weights(spark, sf):
    w = LB.class_weights(_annotations(spark, sf), _vocab_index(spark, sf))
    return w.select("code", "idx", "freq", r6("weight").alias("weight"))


@query
def multi_hot(spark, sf):
    """Every protein's whole vector, zeros included; proteins without codes have only zeros."""
    vi = _vocab_index(spark, sf)
    a = _annotations(spark, sf)
    mh = LB.multi_hot(a.select("protein"), J.code_index(a, vi), vi)
    return mh.select("protein", F.posexplode("multi_hot").alias("idx", "value")).select(
        "protein", F.col("idx").cast("bigint").alias("idx"), F.col("value").cast("double").alias("value"))


@query
def fasta_records(spark, sf):
    recs = V.fasta(spark, sf).withColumn("_rid", F.monotonically_increasing_id())
    return ST.fasta_records(recs, order=["_rid"])


@query
def fasta_lines(spark, sf):
    return ST.fasta_lines(V.fasta(spark, sf))


@query
def pool_swe_numpy(spark, sf):
    """A5, Arrow fast path: numpy matmul projection + numpy quantiles per sorted (set, slice) array."""
    th, ref, w = swe_params()
    out = P.pool_swe(V.tokens(spark, sf), th, ref, w, layout="numpy", project_with="arrow")
    return out.select("seq_id", "slice", r6("value").alias("value"))


# --------------------------------------------------------------------------------------- vector functions, heads

from seqpool.operators import infer as IN  # noqa: E402
from seqpool.operators import score as SC  # noqa: E402
from seqpool.functions.vec import cosine as _cos, dot as _dot, euclidean as _euc, norm as _norm, sq_euclidean as _sqe  # noqa: E402

PROJ_OUT = 8
EVERY_N_VAL = 5


def _bias(n):
    return [o / 10.0 for o in range(n)]


def _proj_long(spark, sf):
    f = V.features(spark, sf)
    z = SC.project(F.col("vec"), PR.projector(PROJ_OUT, DIM), _bias(PROJ_OUT))
    return f.select("key", F.posexplode(z).alias("o", "z")).select("key", F.col("o").cast("bigint").alias("o"), "z")


def _pair_vecs(spark, sf):
    return J.pair_features(V.pairs(spark, sf).select("row_id", "drug_key", "target_key"), V.key_features(spark, sf, V.pair_keys(spark, sf)))


def _scored_pairs(spark, sf, act, cosine):
    """Each distinct key is projected once (with its norm); the narrow vectors are joined, one dot per pair."""
    f = V.key_features(spark, sf, V.pair_keys(spark, sf))
    sides = []
    for offset in (0, 5):
        h = f.select("key", SC.project(F.col("vec"), PR.projector(PROJ_OUT, DIM, offset), act=act).alias("h"))
        sides.append(materialise(h.select("key", "h", F.greatest(_norm("h"), F.lit(1e-8)).alias("norm")), "projected"))
    x = J.lookup_both(V.pairs(spark, sf).drop("label"), J.Side("drug_key", sides[0], {"h": "hd", "norm": "nd"}),
                      J.Side("target_key", sides[1], {"h": "ht", "norm": "nt"}))
    inner = _dot("hd", "ht")
    score = F.least(F.greatest(inner / (F.col("nd") * F.col("nt")), F.lit(-1.0)), F.lit(1.0)) if cosine else inner
    return x.select("row_id", r6(score).alias("score"))


@query
def linspace_points(spark, sf):
    n = V.tokens(spark, sf).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    x = n.select("seq_id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("i"))
    return x.select("seq_id", "i", r6(F.col("i") / (F.col("n") + 1)).alias("x"))


@query
def unit_slices(spark, sf):
    f = V.features(spark, sf)
    u = F.transform("vec", lambda x: x.cast("double") / _norm(F.col("vec")))
    return f.select("key", F.posexplode(u).alias("dim", "value")).select(
        "key", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value"))


@query
def linear_projection(spark, sf):
    return _proj_long(spark, sf).select("key", "o", r6("z").alias("value"))


@query
def activations(spark, sf):
    z = F.col("z")
    return _proj_long(spark, sf).select("key", "o", r6(SC.relu(z)).alias("relu"), r6(SC.elu(z)).alias("elu"),
                                        r6(SC.sigmoid(z)).alias("sigmoid"), r6(SC.leaky_relu(z)).alias("leaky_relu"))


@query
def gelu(spark, sf):
    return _proj_long(spark, sf).select("key", "o", r6(SC.gelu(F.col("z"))).alias("gelu"))


@query
def logistic(spark, sf):
    return V.preds(spark, sf).select("row_id", r6(SC.logistic(F.col("score"), 0.5, 10.0)).alias("value"))


@query
def cosine_scores(spark, sf):
    x = _pair_vecs(spark, sf).select("row_id", _cos("drug_vec", "target_vec").alias("c"))
    return x.select("row_id", r6("c").alias("cosine"), r6(F.col("c") * F.col("c")).alias("sq_cosine"))


@query
def euclidean_scores(spark, sf):
    return _pair_vecs(spark, sf).select("row_id", r6(_euc("drug_vec", "target_vec")).alias("euclidean"),
                                        r6(_sqe("drug_vec", "target_vec")).alias("sq_euclidean"))


@query
def inner_product(spark, sf):
    return _pair_vecs(spark, sf).select("row_id", r6(_dot("drug_vec", "target_vec")).alias("inner"))


@query
def masked_softmax(spark, sf):
    t = P.explode_dims(V.tokens(spark, sf), pos="pos")
    return SC.masked_softmax(t, ["seq_id", "dim"], "x").select("seq_id", "pos", "dim", r6("softmax").alias("value"))


@query
def masked_softmax_padded(spark, sf):
    """H15 with a mask: padded positions of a batch get no weight."""
    x = _padded_batches(spark, sf)
    y = SC.masked_softmax(x, ["seq_id", "dim"], "value", valid=F.col("value") != SENTINEL)
    return y.select("seq_id", "pos", "dim", r6("softmax").alias("value"))


@query
def batch_norm(spark, sf):
    f = V.features(spark, sf)
    long = f.select("key", F.posexplode("vec").alias("dim", "x")).select(
        "key", F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("double").alias("x"))
    return SC.batch_norm(long, "key", "dim", "x").select("key", "dim", r6("value").alias("value"))


@query
def linspace_reference(spark, sf):
    """H4: M evenly spaced points on [-1, 1] per set (M = its size); the single point of M = 1 is -1."""
    n = V.tokens(spark, sf).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    x = n.select("seq_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    point = F.lit(-1.0) + F.coalesce(F.try_divide(F.lit(2.0) * F.col("i"), (F.col("n") - 1).cast("double")), F.lit(0.0))
    return x.select("seq_id", "i", r6(point).alias("x"))


@query
def run_summary(spark, sf):
    """Per run, the mean seconds of an epoch (divided by the evaluation cadence), wall clock and evaluation seconds."""
    ep = V.epochs(spark, sf)
    start, end = (F.unix_micros(F.col(c).cast("timestamp")) / 1e6 for c in ("t_start", "t_end"))
    return ep.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_epochs"), r6(F.avg((end - start) / EVERY_N_VAL)).alias("epoch_time"),
        r6(F.max(end) - F.min(start)).alias("wall_clock"), r6(F.max_by(end - start, "epoch")).alias("eval_time"))


@query
def step_counter(spark, sf):
    """Steps before each batch, epoch * batches * B + i * B."""
    n_rows = V.pairs(spark, sf).select(F.count(F.lit(1))).scalar()
    n_batches = F.ceil(n_rows / F.lit(float(BATCH)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), (n_batches - 1).cast("bigint"))).alias("i")
    x = V.epochs(spark, sf).select("run_id", "epoch", every)
    return x.select("run_id", "epoch", "i", (F.col("epoch") * n_batches * BATCH + F.col("i") * BATCH).cast("bigint").alias("step"))


@query
def checkpoint_events(spark, sf):
    return SC.checkpoint_events(V.epochs(spark, sf)).select("run_id", "epoch", r6("v").alias("v"))


@query
def best_epoch(spark, sf):
    return SC.best_epoch(V.epochs(spark, sf)).select("run_id", "best_epoch", r6("best_v").alias("best_v"))


@query
def cosine_restart_lr(spark, sf):
    return V.epochs(spark, sf).select("run_id", "epoch", r6(SC.cosine_restart_lr(F.col("epoch"), 1e-4, 10) * 1e6).alias("lr_e6"))


@query
def plateau_schedule(spark, sf):
    ep = V.epochs(spark, sf)
    lo = SC.plateau_schedule(ep, 1e-3, factor=0.6, patience=5, mode="min").withColumn("mode", F.lit("min"))
    hi = SC.plateau_schedule(ep, 1e-3, factor=0.6, patience=5, mode="max").withColumn("mode", F.lit("max"))
    return lo.unionByName(hi).select("run_id", "mode", "epoch", r6(F.col("lr") * 1e6).alias("lr_e6"))


@query
def score_pairs_cosine(spark, sf):
    return _scored_pairs(spark, sf, "relu", cosine=True)


@query
def score_pairs_inner(spark, sf):
    return _scored_pairs(spark, sf, "relu", cosine=False)


@query
def score_pairs_gelu(spark, sf):
    return _scored_pairs(spark, sf, "gelu", cosine=False)


LINE_DIM, LINE_SLICES = 4, 8


def _line_swe():
    return PR.slicers(LINE_SLICES, LINE_DIM), PR.permuted_reference(SWE_M, LINE_SLICES), PR.ref_weights(SWE_M)


@query
def score_pairs_pooled(spark, sf):
    """T1 with a ragged target: a supplier's tokens are its lines; each supplier is pooled and projected once."""
    th, ref, w = _line_swe()
    z = P.pool_swe(V.line_tokens(spark, sf), th, ref, w, key="key", layout="sorted", project_with="arrow")
    z = P.pack(z, "key", "slice", "value")
    drugs = V.key_features(spark, sf, V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key")).distinct())
    sides = []
    for x, width, offset in ((drugs, DIM, 0), (z, LINE_SLICES, 5)):
        h = x.select("key", SC.project(F.col("vec"), PR.projector(PROJ_OUT, width, offset), act="relu").alias("h"))
        sides.append(materialise(h.select("key", "h", F.greatest(_norm("h"), F.lit(1e-8)).alias("norm")), "projected"))
    x = J.lookup_both(V.pairs(spark, sf).drop("label"), J.Side("drug_key", sides[0], {"h": "hd", "norm": "nd"}),
                      J.Side("target_key", sides[1], {"h": "ht", "norm": "nt"}))
    score = _dot("hd", "ht") / (F.col("nd") * F.col("nt"))
    return x.select("row_id", r6(F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0))).alias("score"))


@query
def score_edges(spark, sf):
    f = V.key_features(spark, sf, V.edge_keys(spark, sf))
    h = f.select("key", SC.project(F.col("vec"), PR.projector(PROJ_OUT, DIM), act="relu").alias("h"))
    h = materialise(h.select("key", "h", F.greatest(_norm("h"), F.lit(1e-8)).alias("norm")), "projected")
    x = J.lookup_both(V.edges(spark, sf).select("row_id", "p0", "p1"), J.Side("p0", h, {"h": "ha", "norm": "na"}),
                      J.Side("p1", h, {"h": "hb", "norm": "nb"}))
    score = _dot("ha", "hb") / (F.col("na") * F.col("nb"))
    return x.select("row_id", r6(F.least(F.greatest(score, F.lit(-1.0)), F.lit(1.0))).alias("score"))


@query
def score_classes(spark, sf):
    lg = _class_logits(spark, sf)
    return lg.select("vec_id", SC.argmax_first(F.col("logits")).cast("bigint").alias("pred"))


@query
def score_multilabel(spark, sf):
    f = V.features(spark, sf)
    out = SC.multilabel_mlp(F.col("vec"), PR.projector(16, DIM), PR.projector(N_MLAB := 10, 16, 3))
    return f.select("key", F.posexplode(out).alias("label", "logit")).select(
        "key", F.col("label").cast("bigint").alias("label"), r6("logit").alias("logit"))


@query
def score_multilabel_batches(spark, sf):
    """T5 as batch inference: the head is a model that each worker makes once."""
    f = V.features(spark, sf)
    score = IN.batch_scorer(IN.multilabel_model(PR.projector(16, DIM), PR.projector(10, 16, 3)), DIM)
    return f.select("key", F.posexplode(score(F.col("vec"))).alias("label", "logit")).select(
        "key", F.col("label").cast("bigint").alias("label"), r6("logit").alias("logit"))


POOL_METHODS = ("avg", "max", "topk", "swe", "light_attn")


def pool(tokens, method: str, **kw):
    """U4: named pooling front door; unknown names raise."""
    if method in POOL_METHODS and "pos" not in tokens.columns:  # one ready vector per key passes through
        return tokens.select("seq_id", F.posexplode("vec").alias("idx", "value")).withColumn("idx", F.col("idx").cast("bigint"))
    if method == "light_attn":
        return light_attention(tokens)
    if method == "avg":
        return P.pool_avg(tokens).withColumnRenamed("dim", "idx")
    if method == "max":
        return P.pool_max(tokens).withColumnRenamed("dim", "idx")
    if method == "topk":
        return P.pool_topk(tokens, k=kw.get("k", TOPK)).withColumnRenamed("dim", "idx")
    if method == "swe":
        th, ref, w = swe_params()
        return P.pool_swe(tokens, th, ref, w, layout=kw.get("layout", "numpy"),
                          project_with=kw.get("project_with", "arrow")).withColumnRenamed("slice", "idx")
    raise ValueError(f"unknown pooling method {method!r}; expected one of {POOL_METHODS}")


@query
def pool_dispatch(spark, sf):
    t = V.tokens(spark, sf)
    parts = [pool(t, m).select(F.lit(m).alias("method"), "seq_id", "idx", r6("value").alias("value")) for m in POOL_METHODS]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def evaluate(df, metrics):
    """Named metric dispatch -> long (metric, value) table; unknown names raise."""
    fns = {
        "micro_auprc": lambda: M.average_precision(df, "score", "target").select(F.col("average_precision").alias("value")),
        "micro_auroc": lambda: M.auroc(df, "score", "target").select(F.col("auroc").alias("value")),
        "f1_max": lambda: M.f1_max(df).select(F.col("f1_max").alias("value")),
    }
    out = None
    for m in metrics:
        if m not in fns:
            raise ValueError(f"unknown metric {m!r}; expected one of {sorted(fns)}")
        part = fns[m]().select(F.lit(m).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out


@query
def evaluate_dispatch(spark, sf):
    return evaluate(V.mlab(spark, sf), ["micro_auprc", "micro_auroc", "f1_max"]).select("metric", r6("value").alias("value"))


# --------------------------------------------------------------------------------------- store, sinks, encoder host

from seqpool.session import shared_scratch  # noqa: E402
from seqpool.sources import store as SS  # noqa: E402


@query
def encode_distinct(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    x = SS.encode_distinct(d, "text", SS.HashEncoder(8))
    return x.select("doc_id", F.posexplode("vec").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value").cast("double")).alias("value"))


@query
def feature_store_roundtrip(spark, sf):
    path = shared_scratch(spark, "store")
    enc = SS.HashEncoder(8)
    SS.write_missing(spark, _docs(spark, sf).select(F.col("text").alias("key")), path, enc)
    SS.write_missing(spark, _docs(spark, sf).select(F.col("text").alias("key")), path, enc)  # idempotent re-run
    st = SS.read_store(spark, path, enc.name)
    return st.select(F.md5("key").alias("key_md5"), "model", r6(vsum("vec")).alias("vec_sum"))


@query
def feature_store_fallback(spark, sf):
    path = shared_scratch(spark, "store")
    enc = SS.HashEncoder(8)
    SS.write_missing(spark, V.table(spark, sf, "benchmark").select(F.col("text").alias("key")), path, enc)
    x = SS.lookup_with_fallback(spark, _docs(spark, sf).select("doc_id", "text"), "text", path, enc)
    return x.select("doc_id", "source", r6(vsum("vec")).alias("vec_sum"))


@query
def metrics_sink(spark, sf):
    ep = V.epochs(spark, sf)
    secs = (F.unix_micros(F.col("t_end").cast("timestamp")) - F.unix_micros(F.col("t_start").cast("timestamp"))) / 1e6
    long = ep.select("run_id", "epoch", F.lit("val/v").alias("metric"), F.col("v").alias("value")).unionByName(
        ep.select("run_id", "epoch", F.lit("charts/epoch_time").alias("metric"), secs.alias("value")))
    path = shared_scratch(spark, "metrics")
    SS.append_metrics(long, path)
    back = spark.read.parquet(path)
    return back.select("run_id", "epoch", "metric", r6("value").alias("value"))


# --------------------------------------------------------------------------------------- along the positions

import numpy as np  # noqa: E402

from seqpool.operators import fit as FT  # noqa: E402
from seqpool.operators import sequence as SQ  # noqa: E402
from seqpool.operators import train as TR  # noqa: E402
from seqpool.sources import files as FS  # noqa: E402
from seqpool.streaming import jobs as SJ  # noqa: E402

CONV_DIM = DIM
FIT_STEPS = 6
CONV_WIDTH = 5


def _conv_weight(offset):
    o, i, k = np.meshgrid(np.arange(CONV_DIM), np.arange(CONV_DIM), np.arange(CONV_WIDTH), indexing="ij")
    return ((o * 5 + i * 3 + k * 7 + offset) % 11 - 5) / 10.0


@query
def conv1d_same(spark, sf):
    y = SQ.conv1d_same(V.tokens(spark, sf), _conv_weight(0), _bias(CONV_DIM))
    return y.select("seq_id", "pos", F.posexplode("vec").alias("dim", "value")).select(
        "seq_id", "pos", F.col("dim").cast("bigint").alias("dim"), r6("value").alias("value"))


def light_attention(tokens):
    return SQ.pool_light_attention(tokens, _conv_weight(0), _bias(CONV_DIM), _conv_weight(4), _bias(CONV_DIM),
                                   PR.projector(CONV_DIM, 2 * CONV_DIM), _bias(CONV_DIM))


@query
def pool_light_attn(spark, sf):
    return light_attention(V.tokens(spark, sf)).select(
        "seq_id", F.col("idx").cast("bigint").alias("idx"), r6("value").alias("value"))


@query
def pool_swe_ranges(spark, sf):
    """A5 for sets of any size: every (set, slice) of more than 16 tokens is ranked over ranges."""
    th, ref, w = swe_params()
    out = P.pool_swe(V.tokens(spark, sf), th, ref, w, layout="ranges", project_with="arrow", large_set=16)
    return out.select("seq_id", "slice", r6("value").alias("value"))


@query
def pool_swe_masked(spark, sf):
    """SWE of padded batches through the padded knots; padding is found by the sentinel in the first dimension."""
    x = _padded_slots(spark, sf)
    th, ref, w = swe_params()
    out = P.pool_swe_padded(x, SQ.sentinel_valid(F.col("vec"), SENTINEL, first_only=True), th, ref, w, project_with="arrow")
    return out.select("seq_id", "slice", r6("value").alias("value"))


@query
def invalid_shift(spark, sf):
    x = _padded_slots(spark, sf)
    y = SQ.invalid_shift(x, SQ.sentinel_valid(F.col("vec"), SENTINEL, first_only=True))
    return y.select("batch_id", "seq_id", "pos", r6("shift").alias("shift"))


@query
def reference_argsort(spark, sf):
    """K3: order of reference points on each slice; the points are the labels' mean vectors."""
    e = V.table(spark, sf, "embeddings")
    long = e.select(F.col("label").cast("bigint").alias("m"), F.posexplode("embedding").alias("d", "x"))
    mean = long.groupBy("m", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"])  # DIM values
    p = mean.groupBy("m").agg(vec.alias("vec")).select("m", F.posexplode(matvec(PR.slicers(SWE_L, DIM), "vec")).alias("slice", "p"))
    from pyspark.sql import Window
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("p", "m")) - 1
    return p.select(F.col("slice").cast("bigint").alias("slice"), "m", rank.cast("bigint").alias("rank"))


@query
def interp1d(spark, sf):
    """Knots are a set's first dimension, values its second; nine points from below the first to above the last."""
    t = V.tokens(spark, sf).select("seq_id", "pos", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    ends = t.groupBy("seq_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint")))
    points = ends.select("*", j.alias("j")).select(
        "seq_id", "j", (F.col("lo") - 0.5 + F.col("j") * (F.col("hi") - F.col("lo") + 1.0) / 8.0).alias("at"))
    return interpolate(t, points, ["seq_id"]).select("seq_id", "j", r6("value").alias("y"))


@query
def concat_features(spark, sf):
    """The features of two named encoders, one behind the other."""
    x = SS.encode_concat(_docs(spark, sf).select("doc_id", "source"), "source", "hash8,salted4")
    return x.select("doc_id", F.posexplode("vec").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value").cast("double")).alias("value"))


# --------------------------------------------------------------------------------------- files


@query
def scan_split_csv(spark, sf):
    path = shared_scratch(spark, "split-csv")
    e = V.edges(spark, sf).select(F.monotonically_increasing_id().alias("index"), "row_id", "p0", "p1", "label", "split")
    e.write.partitionBy("split").option("header", "true").csv(path)
    return FS.scan_split_csv(spark, path, "row_id string, p0 string, p1 string, label bigint")


@query
def scan_flagged_csv(spark, sf):
    """Whole texts, with quotes and line ends, through a CSV; the split comes from the row's own columns."""
    path = shared_scratch(spark, "flagged-csv")
    s = V.splits(spark, sf).select("doc_id", "sequence", "target", "set", "validation")
    s.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    x = FS.scan_flagged_csv(spark, path, "doc_id bigint, sequence string, target string, `set` string, validation boolean")
    return x.select("doc_id", F.md5("sequence").alias("sequence_md5"), PP.nullsafe_split(x).alias("split"))


@query
def scan_edge_lists(spark, sf):
    path = shared_scratch(spark, "edge-lists")
    number = F.when(F.col("split") == "train", "1").when(F.col("split") == "val", "0").otherwise("2")
    name = F.concat(F.lit("Intra"), number, F.when(F.col("label") == 1, "_pos").otherwise("_neg"))
    V.edges(spark, sf).select("p0", "p1", name.alias("name")).write.partitionBy("name").option("sep", " ").csv(path)
    x = FS.scan_edge_lists(spark, path)
    return x.groupBy("p0", "p1", "label", "split").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_fasta(spark, sf):
    """FASTA files written and read back, record by record."""
    path = shared_scratch(spark, "fasta")
    V.fasta(spark, sf).write.text(path)
    return ST.fasta_records(ST.read_fasta_records(spark, path))


@query
def scan_fasta_lines(spark, sf):
    """FASTA files written and read back, line by line."""
    path = shared_scratch(spark, "fasta")
    V.fasta(spark, sf).write.text(path)
    return ST.fasta_lines(ST.read_fasta_records(spark, path))


@query
def scan_annotation_tsv(spark, sf):
    """Annotation files (title, vocabulary, title, then a line per protein) written and read back."""
    path = shared_scratch(spark, "annotation")
    codes = [r["code"] for r in _vocab_index(spark, sf).orderBy("idx").collect()]  # the vocabulary
    ST.write_annotation_tsv(V.annot_lines(spark, sf), codes, path)
    vocab, lines = ST.read_annotation_tsv(spark, path)
    return J.code_index(J.last_lines(lines, "line"), vocab).select("protein", F.col("pos").cast("bigint").alias("pos"), "code", "idx")


@query
def scan_membership(spark, sf):
    """Membership flags through a CSV, filtered at one threshold."""
    path = shared_scratch(spark, "members")
    V.members(spark, sf).write.option("header", "true").csv(path)
    return PP.identity_filter(FS.scan_membership(spark, path), 50).select("protein")


# --------------------------------------------------------------------------------------- streams and fits


@query
def stream_featurize(spark, sf):
    """Documents arrive file by file, those of two languages after the others; a second run goes on in the same store."""
    folder, store, state = (shared_scratch(spark, f"stream-{x}") for x in ("in", "features", "state"))
    d = _docs(spark, sf).select("doc_id", "text", "lang")
    late = F.col("lang").isin("de", "es")
    enc = SS.HashEncoder(8)
    for rows in (d.where(~late | F.col("lang").isNull()), d.where(late)):
        rows.repartition(6, "doc_id").write.mode("append").parquet(folder)
        SJ.stream_featurize(spark, folder, d.schema, "text", enc, store=store, checkpoint=state)
    st = SS.read_store(spark, store, enc.name)
    return st.select(F.md5("key").alias("key_md5"), "model", r6(vsum("vec")).alias("vec_sum"))


@query
def stream_metrics(spark, sf):
    """Confusion counts and squared error as running state over scored files."""
    folder = shared_scratch(spark, "stream-in")
    x = line_preds(spark, sf).where(F.col("score").isNotNull()).select("protein", "score", "label")
    x.repartition(12, "protein").write.parquet(folder)
    p, y = F.col("score") > 0.5, F.col("label") == 1
    sums = {"n": F.count(F.lit(1)), "tp": F.count_if(p & y), "fp": F.count_if(p & ~y), "fn": F.count_if(~p & y),
            "tn": F.count_if(~p & ~y), "se": F.sum(F.pow(F.col("score") - F.col("label"), 2))}
    s = SJ.stream_sums(spark, folder, x.schema, sums)
    return s.select("tp", "fp", "fn", "tn", r6(F.col("se") / F.col("n")).alias("mse"))


@query
def stream_rank_metrics(spark, sf):
    """Average precision and AUROC from per-score counts kept over a stream of scored files."""
    folder = shared_scratch(spark, "stream-in")
    x = line_preds(spark, sf).select("protein", "score", "label")
    x.repartition(8, "protein").write.parquet(folder)
    curve = materialise(M.curve_of_counts(SJ.stream_score_counts(spark, folder, x.schema)), "stream-curve")
    both = M.average_precision_of(curve).join(M.auroc_of(curve))  # a row each
    return both.select(r6("average_precision").alias("average_precision"), r6("auroc").alias("auroc"))


@query
def fit_class_head(spark, sf):
    """T6 + S12: the class head fitted on all labelled vectors, its parameters saved and loaded, the predictions of both."""
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")
    model = FT.fit_class_head(e)
    path = shared_scratch(spark, "class-head")
    FT.save_parameters(model, path)
    one = FT.predict_class(model, e, "vec_id")
    two = FT.predict_class(FT.load_parameters(path), e, "vec_id").withColumnRenamed("pred", "pred_loaded")
    return one.join(two, "vec_id")


def _losses(spark, losses):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "step bigint, loss double")


@query
def fit_pair_head(spark, sf):
    """Projectors fitted on all pairs by full-batch steps; the loss before each step."""
    x = materialise(J.pair_blocks(V.pairs(spark, sf), V.key_features(spark, sf, V.pair_keys(spark, sf))), "pair-blocks")
    _, losses = FT.fit_pair_head(x, PR.projector(PROJ_OUT, DIM), PR.projector(PROJ_OUT, DIM, 5), steps=FIT_STEPS)
    return _losses(spark, losses)


@query
def fit_multilabel_head(spark, sf):
    """The two-layer head fitted on all labelled vectors (one label of ten is set), labels weighted by their frequency."""
    x, weights = _multilabel_rows(spark, sf)
    _, losses = FT.fit_multilabel_head(x, PR.projector(16, DIM), PR.projector(N_CLASSES, 16, 3), weights, steps=FIT_STEPS)
    return _losses(spark, losses)


def _multilabel_rows(spark, sf):
    """All labelled vectors with their targets (one label of ten is set), and the labels' weights."""
    e = V.table(spark, sf, "embeddings").where("label IS NOT NULL")
    labels = F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), lambda i: (i == F.col("label")).cast("double"))
    x = materialise(e.select(F.col("embedding").cast("array<double>").alias("vec"), labels.alias("targets")), "label-rows")
    counts = {r["label"]: r["n"] for r in e.groupBy(F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    return x, np.array([n / counts[i] if i in counts else 0.0 for i in range(N_CLASSES)])


@query
def fit_multilabel_start(spark, sf):
    """The weighted loss at the start, and its gradient by both layers, over all labelled vectors."""
    x, weights = _multilabel_rows(spark, sf)
    params = {"w1": PR.projector(16, DIM), "w2": PR.projector(N_CLASSES, 16, 3)}
    loss, n, grads = FT.gradient_sums(x, params, FT.multilabel_bce(weights))
    out = [("loss", 0, loss / max(n, 1))] + [(k, i, float(g) / max(n, 1)) for k in params for i, g in enumerate(grads[k].ravel())]
    return spark.createDataFrame(out, "name string, idx bigint, value double").withColumn("value", r6("value"))


def _pooled_training(spark, sf, n_batches):
    """Pairs by batch: the part's feature, the supplier's lines as tokens, the label."""
    drugs = V.key_features(spark, sf, V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key")).distinct())
    tokens = V.line_tokens(spark, sf).withColumn("pos", F.conv(F.substring("pos", 1, 15), 16, 10).cast("bigint"))  # the order of row ids, in eight bytes
    return TR.write_tables(V.pairs(spark, sf), drugs, tokens, n_batches, LINE_SLICES)


def _pooled_params():
    th, ref, w = _line_swe()
    return {"drug": PR.projector(PROJ_OUT, DIM), "target": PR.projector(PROJ_OUT, LINE_SLICES, 5), "theta": th, "reference": ref, "weight": w}


@query
def fit_pair_start(spark, sf):
    """The loss at the start, and its gradient by the weights of the reference points, over all pairs."""
    loss, n, grads = TR.table_sums(spark, _pooled_training(spark, sf, 1), 0, _pooled_params())
    out = [("loss", 0, loss / n)] + [("weight", i, float(g) / n) for i, g in enumerate(grads["weight"])]
    return spark.createDataFrame(out, "name string, idx bigint, value double").withColumn("value", r6("value"))


@query
def fit_pair_pooled(spark, sf):
    """Pooling and projectors trained by mini-batches; the last is held out for validation.  Loss and value per epoch."""
    n = 5
    tables = _pooled_training(spark, sf, n)

    def measure(params):
        return M.average_precision(TR.table_scores(spark, tables, n - 1, params)).first()[0]

    state = TR.fit_epochs(spark, tables, n - 1, _pooled_params(), TR.table_sums, measure, shared_scratch(spark, "fit"), epochs=2)
    return spark.createDataFrame([(h["epoch"], h["loss"], h["value"]) for h in state.history], "epoch bigint, loss double, value double")


WITHOUT_SQL |= {"fit_class_head", "fit_pair_head", "fit_multilabel_head", "fit_pair_pooled"}
