"""DuckDB SQL equivalents of the registered queries (independent formulations, same views).

Conventions: doubles rounded to 6 digits, generated integers cast to BIGINT, double
literals written as ``x::DOUBLE`` (plain ``1.0`` is DECIMAL in DuckDB).
"""

from __future__ import annotations

from seqpool.plans.catalog import DIM, SWE_L, SWE_M, TOPK

SQL: dict[str, str] = {}

# ---------------------------------------------------------------------------------- views

TOKENS = """tokens AS (
  SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS seq_id,
         vec_id - CAST(floor(sqrt(vec_id)) AS BIGINT) * CAST(floor(sqrt(vec_id)) AS BIGINT) AS pos,
         embedding AS vec
  FROM embeddings)"""

TOKEN_DIMS = """tdims AS (
  SELECT seq_id, pos, CAST(unnest(range(len(vec))) AS BIGINT) AS dim, CAST(unnest(vec) AS DOUBLE) AS x
  FROM tokens)"""


def theta_cte(n_slices: int = SWE_L, dim: int = DIM) -> str:
    return f"""th0 AS (
  SELECT l.l AS l, d.d AS d, ((l.l * 31 + d.d * 17) % 23 - 11) / 11.0::DOUBLE AS raw
  FROM range({n_slices}) l(l), range({dim}) d(d)),
th AS (SELECT l, d, raw / sqrt(sum(raw * raw) OVER (PARTITION BY l)) AS t FROM th0)"""


def proj_cte() -> str:
    return """proj AS (
  SELECT tdims.seq_id, tdims.pos, th.l AS slice, sum(tdims.x * th.t) AS p
  FROM tdims JOIN th ON tdims.dim = th.d
  GROUP BY tdims.seq_id, tdims.pos, th.l)"""


def ref_cte(n_ref: int = SWE_M, n_slices: int = SWE_L) -> str:
    return f"""ref AS (
  SELECT l.l AS slice, m.m AS m,
         -1.0::DOUBLE + 2.0::DOUBLE * ((m.m * 7 + l.l * 3) % {n_ref}) / {n_ref - 1}.0::DOUBLE AS r,
         ((m.m % 7) + 1) / (4.0::DOUBLE * {n_ref}) AS w
  FROM range({n_slices}) l(l), range({n_ref}) m(m)),
refrank AS (SELECT slice, m, row_number() OVER (PARTITION BY slice ORDER BY r, m) - 1 AS rk FROM ref),
refpts AS (SELECT ref.slice, ref.m, ref.r, ref.w, refrank.m AS a
           FROM ref JOIN refrank ON ref.slice = refrank.slice AND ref.m = refrank.rk)"""


SORTED = """sv AS (SELECT seq_id, slice, list(p ORDER BY p, pos) AS v, count(*) AS n FROM proj GROUP BY seq_id, slice)"""


def quantile_sql(m: int = SWE_M, eps: str = "1.1920929e-07::DOUBLE") -> str:
    """q at 1-based point j of sorted list v with n elements (columns j, v, n in scope)."""
    below = f"len(list_filter(range(1, n + 1), lambda i: i * {m + 1} < j * (n + 1)))"  # knots below the point, counted one by one
    i0 = f"least(greatest({below} - 1, 0), n - 2)"
    return f"""CASE WHEN n = 1 THEN v[1] WHEN n = {m} THEN v[j]
     ELSE v[{i0} + 1] + (v[{i0} + 2] - v[{i0} + 1]) / ({eps} + 1.0::DOUBLE / (n + 1))
          * (j / {m + 1}.0::DOUBLE - ({i0} + 1) / (n + 1.0::DOUBLE)) END"""


SWE_PREFIX = f"""WITH {TOKENS},
{TOKEN_DIMS},
{theta_cte()},
{proj_cte()},
{SORTED},
{ref_cte()}"""

SQL["pool_swe"] = f"""{SWE_PREFIX},
qs AS (SELECT sv.seq_id, sv.slice, refpts.r, refpts.w, refpts.a + 1 AS j, sv.v, sv.n
       FROM sv JOIN refpts ON sv.slice = refpts.slice),
qv AS (SELECT seq_id, slice, w, r, {quantile_sql()} AS q FROM qs)
SELECT seq_id, CAST(slice AS BIGINT) AS slice, round(sum(w * (r - q)), 6) AS value
FROM qv GROUP BY seq_id, slice"""

SQL["pool_swe_window"] = SQL["pool_swe_arrays"] = SQL["pool_swe"]
SQL["pool_swe_numpy"] = SQL["pool_swe"]

SQL["swe_displacement"] = f"""{SWE_PREFIX},
qs AS (SELECT sv.seq_id, sv.slice, refpts.m, refpts.r, refpts.a + 1 AS j, sv.v, sv.n
       FROM sv JOIN refpts ON sv.slice = refpts.slice)
SELECT seq_id, CAST(slice AS BIGINT) AS slice, CAST(m AS BIGINT) AS m, round(r - ({quantile_sql()}), 6) AS value
FROM qs"""

for _name, _agg in (("pool_avg", "avg(x)"), ("pool_max", "max(x)")):
    SQL[_name] = f"""WITH {TOKENS},
{TOKEN_DIMS}
SELECT seq_id, dim, round({_agg}, 6) AS value FROM tdims GROUP BY seq_id, dim"""

SQL["pool_topk"] = f"""WITH {TOKENS},
{TOKEN_DIMS},
ranked AS (SELECT seq_id, dim, x, row_number() OVER (PARTITION BY seq_id, dim ORDER BY x DESC) AS rk FROM tdims)
SELECT seq_id, dim, round(avg(x), 6) AS value FROM ranked WHERE rk <= {TOPK} GROUP BY seq_id, dim"""

SQL["slice_rank"] = f"""WITH {TOKENS},
{TOKEN_DIMS},
{theta_cte()},
{proj_cte()}
SELECT seq_id, pos, CAST(slice AS BIGINT) AS slice,
       CAST(row_number() OVER (PARTITION BY seq_id, slice ORDER BY p, pos) - 1 AS BIGINT) AS rank,
       round(p, 6) AS p
FROM proj"""

SQL["slice_end_slope"] = f"""WITH {TOKENS},
{TOKEN_DIMS},
{theta_cte()},
{proj_cte()},
g AS (SELECT seq_id, slice, count(*) AS n, max(p) AS max1,
             list(p ORDER BY p DESC, pos)[2] AS max2 FROM proj GROUP BY seq_id, slice)
SELECT seq_id, CAST(slice AS BIGINT) AS slice, round(max1 - max2, 6) AS gap, round((max1 - max2) * (n + 1), 6) AS slope
FROM g"""

SQL["sorted_slices"] = f"""WITH {TOKENS},
{TOKEN_DIMS},
{theta_cte()},
{proj_cte()}
SELECT seq_id, CAST(slice AS BIGINT) AS slice,
       CAST(row_number() OVER (PARTITION BY seq_id, slice ORDER BY p, pos) - 1 AS BIGINT) AS idx,
       round(p, 6) AS p
FROM proj"""

# ---------------------------------------------------------------------------------- metrics

PREDS = """preds AS (
  SELECT d.doc_id AS row_id, (d.n_chars % 101) / 101.0::DOUBLE AS score, CAST(l.quality AS BIGINT) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

MLAB = """mlab AS (
  SELECT d.doc_id AS protein, g.label AS label,
         ((d.doc_id * 7 + g.label * 13) % 97) / 97.0::DOUBLE AS score,
         CAST(((d.doc_id * 3 + g.label * 5) % 7) = 0 AS BIGINT) AS target
  FROM documents d, range(10) g(label))"""

REG = """reg AS (SELECT l_quantity * 1500.0::DOUBLE AS p, l_extendedprice AS y FROM lineitem)"""

MEMBERS = """members AS (
  SELECT CAST(doc_id AS VARCHAR) AS protein,
         CASE WHEN doc_id % 10 < 3 THEN '1' ELSE '0' END AS p30,
         CASE WHEN doc_id % 10 < 4 THEN '1' ELSE '0' END AS p40,
         CASE WHEN doc_id % 10 < 5 THEN '1' ELSE '0' END AS p50,
         CASE WHEN doc_id % 10 < 7 THEN '1' ELSE '0' END AS p70,
         CASE WHEN doc_id % 20 < 19 THEN '1' ELSE '0' END AS p95
  FROM documents)"""

EPOCHS = """epochs AS (
  SELECT event_type AS run_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch,
         avg(value) AS v, min(ts) AS t_start, max(ts) AS t_end
  FROM events GROUP BY 1, 2)"""


def ap_sql(src: str, score: str, label: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""c AS (SELECT {g}{score} AS score, sum({label})::DOUBLE AS tp, sum(1 - {label})::DOUBLE AS fp FROM {src} GROUP BY {g}{score}),
cc AS (SELECT {g}score, tp, fp,
              sum(tp) OVER ({part}ORDER BY score DESC) AS ctp, sum(fp) OVER ({part}ORDER BY score DESC) AS cfp,
              sum(tp) OVER ({part.strip()}) AS ttp, sum(fp) OVER ({part.strip()}) AS tfp FROM c)"""


SQL["metric_average_precision"] = f"""WITH {PREDS},
{ap_sql('preds', 'score', 'label')}
SELECT round(sum(tp * ctp / (ctp + cfp)) / max(ttp), 6) AS average_precision FROM cc"""

SQL["metric_auroc"] = f"""WITH {PREDS},
{ap_sql('preds', 'score', 'label')}
SELECT round(sum(fp * (2 * ctp - tp)) / 2.0::DOUBLE / (max(ttp) * max(tfp)), 6) AS auroc FROM cc"""

SQL["pr_roc_curve"] = f"""WITH {PREDS},
{ap_sql('preds', 'score', 'label')}
SELECT round(score, 6) AS score, CAST(ctp AS BIGINT) AS tp, CAST(cfp AS BIGINT) AS fp,
       round(ctp / (ctp + cfp), 6) AS precision, round(ctp / ttp, 6) AS recall, round(cfp / tfp, 6) AS fpr
FROM cc"""

SQL["metric_binary_confusion"] = f"""WITH {PREDS},
k AS (SELECT count(*) FILTER (WHERE score > 0.5::DOUBLE AND label = 1)::DOUBLE AS tp,
             count(*) FILTER (WHERE score > 0.5::DOUBLE AND label <> 1)::DOUBLE AS fp,
             count(*) FILTER (WHERE NOT score > 0.5::DOUBLE AND label = 1)::DOUBLE AS fn,
             count(*) FILTER (WHERE NOT score > 0.5::DOUBLE AND label <> 1)::DOUBLE AS tn FROM preds)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
       round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
       round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
       round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc
FROM k"""

SQL["metric_regression"] = f"""WITH {REG}
SELECT round(avg((p - y) * (p - y)), 6) AS mse, round(corr(p, y), 6) AS pearson FROM reg"""

SQL["metric_micro_auprc"] = f"""WITH {MLAB},
{ap_sql('mlab', 'score', 'target')}
SELECT round(sum(tp * ctp / (ctp + cfp)) / max(ttp), 6) AS micro_auprc FROM cc"""

SQL["metric_micro_auroc"] = f"""WITH {MLAB},
{ap_sql('mlab', 'score', 'target')}
SELECT round(sum(fp * (2 * ctp - tp)) / 2.0::DOUBLE / (max(ttp) * max(tfp)), 6) AS micro_auroc FROM cc"""


def fmax_sql(src: str, group: str = "") -> str:
    """Brute force: every distinct threshold joined with every row at or above it."""
    g = f"{group}, " if group else ""
    tg = f"thr.{group}, " if group else ""
    on_g = f" AND s.{group} = thr.{group}" if group else ""
    n_src = f"(SELECT count(DISTINCT protein) FROM {src} x WHERE x.{group} = pp.{group})" if group else \
        f"(SELECT count(DISTINCT protein) FROM {src})"
    return f"""thr AS (SELECT DISTINCT {g}score AS t FROM {src}),
pp AS (SELECT {tg}thr.t, s.protein, sum(s.target)::DOUBLE AS tp, count(*)::DOUBLE AS k
       FROM thr JOIN {src} s ON s.score >= thr.t{on_g} GROUP BY ALL),
npos AS (SELECT {g}protein, sum(target)::DOUBLE AS np FROM {src} GROUP BY ALL),
f AS (SELECT {"pp." + group + ", " if group else ""}pp.t, avg(pp.tp / pp.k) AS p,
             sum(pp.tp / (npos.np + 1e-10::DOUBLE)) / any_value({n_src}) AS r
      FROM pp JOIN npos ON pp.protein = npos.protein{" AND pp." + group + " = npos." + group if group else ""}
      GROUP BY ALL)"""


LINE_PREDS = """lp AS (SELECT l_orderkey AS protein, l_extendedprice / (l_quantity * 2500.0::DOUBLE) AS score,
              CAST(l_returnflag = 'R' AS BIGINT) AS label, CASE WHEN l_linestatus = 'O' THEN CAST(month(l_shipdate) AS BIGINT) END AS grp
       FROM lineitem WHERE l_linenumber < 7)"""

SQL["line_average_precision"] = f"""WITH {LINE_PREDS},
{ap_sql('lp', 'score', 'label')}
SELECT round(sum(tp * ctp / (ctp + cfp)) / max(ttp), 6) AS average_precision FROM cc"""

SQL["line_auroc_by_group"] = f"""WITH {LINE_PREDS},
{ap_sql('lp', 'score', 'label', 'grp')}
SELECT grp, round(sum(fp * (2 * ctp - tp)) / 2.0::DOUBLE / nullif(max(ttp) * max(tfp), 0), 6) AS auroc FROM cc GROUP BY grp"""

SQL["line_f1_max"] = f"""WITH {LINE_PREDS},
s AS (SELECT protein, score, count(*)::DOUBLE AS k, sum(label)::DOUBLE AS h FROM lp GROUP BY 1, 2),
r AS (SELECT protein, score, sum(k) OVER w AS ck, sum(h) OVER w AS ch, sum(h) OVER (PARTITION BY protein) AS np,
             row_number() OVER (PARTITION BY protein ORDER BY score DESC) AS rk
      FROM s WINDOW w AS (PARTITION BY protein ORDER BY score DESC)),
d AS (SELECT score, ch / ck - coalesce(lag(ch / ck) OVER p, 0) AS dp,
             (ch - coalesce(lag(ch) OVER p, 0)) / (np + 1e-10::DOUBLE) AS dr, CASE WHEN rk = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ds
      FROM r WINDOW p AS (PARTITION BY protein ORDER BY score DESC)),
t AS (SELECT score, sum(dp) AS dp, sum(dr) AS dr, sum(ds) AS ds FROM d GROUP BY score),
c AS (SELECT sum(dp) OVER (ORDER BY score DESC) / sum(ds) OVER (ORDER BY score DESC) AS p,
             sum(dr) OVER (ORDER BY score DESC) / sum(ds) OVER () AS r FROM t)
SELECT round(max(2 * p * r / (p + r + 1e-10::DOUBLE)), 6) AS f1_max FROM c"""

SQL["metric_f1_max"] = f"""WITH {MLAB},
{fmax_sql('mlab')}
SELECT round(max(2 * p * r / (p + r + 1e-10::DOUBLE)), 6) AS f1_max FROM f"""

BY_IDENTITY = f"""{MLAB},
{MEMBERS},
lvl AS (SELECT protein, 95::BIGINT AS percent FROM members WHERE p95 = '1'
        UNION ALL SELECT protein, 50::BIGINT FROM members WHERE p50 = '1'
        UNION ALL SELECT protein, 30::BIGINT FROM members WHERE p30 = '1'),
x AS (SELECT lvl.percent, mlab.* FROM mlab JOIN lvl ON CAST(mlab.protein AS VARCHAR) = lvl.protein)"""

SQL["metric_by_identity"] = f"""WITH {BY_IDENTITY},
{ap_sql('x', 'score', 'target', 'percent')},
{fmax_sql('x', 'percent')},
ap AS (SELECT percent, sum(tp * ctp / (ctp + cfp)) / max(ttp) AS ap FROM cc GROUP BY percent),
fm AS (SELECT percent, max(2 * p * r / (p + r + 1e-10::DOUBLE)) AS fm FROM f GROUP BY percent)
SELECT ap.percent, round(ap.ap, 6) AS micro_auprc, round(fm.fm, 6) AS f1_max FROM ap JOIN fm ON ap.percent = fm.percent"""

EMB_LOGITS = """proj_w AS (SELECT o.o AS o, i.i AS i, ((o.o * 13 + i.i * 7) % 19 - 9) / 90.0::DOUBLE AS w
                FROM range(10) o(o), range(64) i(i)),
edims AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(unnest(range(len(embedding))) AS BIGINT) AS i,
                 CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
lg AS (SELECT edims.vec_id, any_value(edims.label) AS label, proj_w.o, sum(proj_w.w * edims.x) AS z
       FROM edims JOIN proj_w ON edims.i = proj_w.i GROUP BY edims.vec_id, proj_w.o)"""

SQL["metric_multiclass_accuracy"] = f"""WITH {EMB_LOGITS},
am AS (SELECT vec_id, any_value(label) AS label, arg_max(o, z * 1e6::DOUBLE - o) AS pred FROM lg GROUP BY vec_id)
SELECT round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM am"""

SQL["loss_cross_entropy"] = f"""WITH {EMB_LOGITS},
ce2 AS (SELECT lg.vec_id, max(lg.z) AS mz, ln(sum(exp(lg.z - m.mz))) + m.mz AS lse,
               max(CASE WHEN lg.o = lg.label THEN lg.z END) AS zl
        FROM lg JOIN (SELECT vec_id, max(z) AS mz FROM lg GROUP BY vec_id) m ON lg.vec_id = m.vec_id
        GROUP BY lg.vec_id, m.mz)
SELECT round(avg(lse - zl), 6) AS cross_entropy FROM ce2"""

BCE = """(-(({y}) * CASE WHEN ({p}) <= 0 THEN -100.0::DOUBLE ELSE greatest(ln({p}), -100.0::DOUBLE) END
   + (1.0::DOUBLE - ({y})) * CASE WHEN ({p}) >= 1 THEN -100.0::DOUBLE ELSE greatest(ln(1.0::DOUBLE - ({p})), -100.0::DOUBLE) END))"""

SQL["loss_bce"] = f"""WITH {PREDS}
SELECT round(avg({BCE.format(p='score', y='CAST(label AS DOUBLE)')}), 6) AS bce FROM preds"""

SQL["loss_weighted_bce"] = f"""WITH {MLAB},
wt AS (SELECT label, (SELECT count(DISTINCT protein) FROM mlab)::DOUBLE / nullif(sum(target), 0)::DOUBLE AS weight
       FROM mlab GROUP BY label),
s AS (SELECT mlab.*, wt.weight, 1.0::DOUBLE / (1.0::DOUBLE + exp(-score)) AS sg FROM mlab LEFT JOIN wt ON mlab.label = wt.label)
SELECT round(avg(weight * {BCE.format(p='sg', y='CAST(target AS DOUBLE)')}), 6) AS weighted_bce FROM s"""

SQL["epoch_timing"] = f"""WITH {EPOCHS}
SELECT run_id, epoch, round(date_diff('microsecond', t_start, t_end) / 1e6::DOUBLE, 6) AS seconds FROM epochs"""

# ---------------------------------------------------------------------------------- preparation

ROW_ID = """md5(concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR,
    CAST(round(l_quantity * 100) AS BIGINT)::VARCHAR, CAST(round(l_extendedprice * 100) AS BIGINT)::VARCHAR,
    date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))::VARCHAR))"""

PAIRS = f"""pairs AS (SELECT {ROW_ID} AS row_id, l_partkey AS drug_key, l_suppkey AS target_key,
                  CAST(l_returnflag = 'R' AS BIGINT) AS label FROM lineitem)"""

EDGES = f"""edges0 AS (SELECT {ROW_ID} AS row_id, l_partkey, l_suppkey, l_returnflag FROM lineitem),
edges AS (SELECT row_id, CAST(l_partkey AS VARCHAR) AS p0, CAST(l_suppkey AS VARCHAR) AS p1,
                 CAST(l_returnflag = 'R' AS BIGINT) AS label,
                 CASE WHEN ('0x' || substr(md5('split|' || row_id), 1, 8))::BIGINT % 10 < 7 THEN 'train'
                      WHEN ('0x' || substr(md5('split|' || row_id), 1, 8))::BIGINT % 10 < 8 THEN 'val'
                      ELSE 'test' END AS split
          FROM edges0)"""

REG_ID = f"""reg AS (SELECT {ROW_ID} AS row_id, l_quantity * 1500.0::DOUBLE AS p, l_extendedprice AS y FROM lineitem)"""

SPLITS = """splits AS (
  SELECT d.doc_id, d.text AS sequence, d.lang AS target,
         CASE WHEN d.source IN ('src0', 'src1', 'src2', 'src3') THEN 'test' ELSE 'train' END AS "set",
         (l.quality = 0) AS validation
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
srows AS (
  SELECT doc_id, target,
         CASE WHEN "set" = 'test' THEN 'test'
              WHEN "set" = 'train' AND validation IS NOT DISTINCT FROM TRUE THEN 'val'
              WHEN "set" = 'train' THEN 'train' END AS split
  FROM splits)"""


def letters(x: str) -> str:
    """a-z upper-cased, everything else as it is."""
    return f"translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def chars(x: str) -> str:
    return f"list_filter(string_split({x}, ''), lambda c: c <> '')"


RES = f"list_transform({chars(letters('text'))}, lambda c: greatest(instr('GASPVTCILNDQKEMHFRYW', c) - 1, 0))"
TOK = (f"list_filter(list_transform({chars(chr(39) + '1' + chr(39) + ' || ' + letters('text') + ' || ' + chr(39) + '2' + chr(39))}, "
       "lambda c: CASE WHEN instr('12ABCDEFGHIKLMNOPQRSTUVWXYZ', c) > 0 THEN instr('12ABCDEFGHIKLMNOPQRSTUVWXYZ', c) + 2 END), "
       "lambda x: x IS NOT NULL)")


def wsum(lst: str) -> str:
    return f"coalesce(list_sum(list_transform({lst}, lambda x, i: CAST(x AS BIGINT) * i)), 0)::BIGINT"


def lsum(lst: str) -> str:
    return f"coalesce(list_sum({lst}), 0)::BIGINT"


def ngram_buckets(s: str) -> str:
    poly = f"(unicode(substr({s}, i, 1)) * 961 + unicode(substr({s}, i + 1, 1)) * 31 + unicode(substr({s}, i + 2, 1))) % 4294967296"
    return (f"list_distinct(list_transform(range(1, length({s}) - 1), "
            f"lambda i: ((({poly}) * 2654435761) % 4294967296) * 2048 // 4294967296))")


HASH_ORDER = "('0x' || substr(md5('12345|' || CAST({x} AS VARCHAR)), 1, 15))::BIGINT"

SQL["project_pair_columns"] = f"""WITH {PAIRS}
SELECT row_id, drug_key AS drug, target_key AS target, CAST(label AS DOUBLE) AS label FROM pairs"""

SQL["nullsafe_split"] = f"""WITH {SPLITS} SELECT doc_id, split FROM srows"""

SQL["normalize_sequence"] = f"""SELECT doc_id, substr({letters('text')}, 1, 1022) AS seq FROM documents"""

SQL["residue_record"] = f"""WITH r AS (SELECT doc_id, {RES} AS res FROM documents)
SELECT doc_id, CAST(len(res) AS BIGINT) AS n, {wsum('res')} AS residue_wsum,
       CAST(len(res) * (len(res) - 1) / 2 AS BIGINT) AS number_sum, CAST(6 * len(res) AS BIGINT) AS atom_sum FROM r"""

SQL["truncate_residues"] = f"""WITH r AS (SELECT doc_id, ({RES})[1:550] AS res FROM documents)
SELECT doc_id, CAST(len(res) AS BIGINT) AS n, {wsum('res')} AS residue_wsum,
       CAST(len(res) * (len(res) - 1) / 2 AS BIGINT) AS number_sum FROM r"""

SQL["center_positions"] = f"""WITH r AS (SELECT doc_id, ({RES}) AS res FROM documents),
e AS (SELECT doc_id, CAST(unnest(res) AS DOUBLE) AS x0, CAST(unnest(range(len(res))) AS DOUBLE) AS x1 FROM r),
e2 AS (SELECT doc_id, x0, x1, CAST((CAST(x1 AS BIGINT) * CAST(x1 AS BIGINT)) % 17 AS DOUBLE) AS x2 FROM e)
SELECT doc_id, round(sqrt(var_pop(x0) + var_pop(x1) + var_pop(x2)), 6) AS centered_rms FROM e2 GROUP BY doc_id"""

SQL["sanitize_key"] = """SELECT page_id, replace(url, '/', '|') AS key FROM pages"""

SQL["identity_filter"] = f"""WITH {MEMBERS} SELECT protein FROM members WHERE p50 = '1'"""

SQL["trim_tokens"] = """WITH a AS (SELECT vec_id, 'drop_ends' AS variant, embedding[2:len(embedding) - 1] AS t FROM embeddings
                  UNION ALL SELECT vec_id, 'drop_last_two', embedding[1:len(embedding) - 2] FROM embeddings)
SELECT vec_id, variant, CAST(unnest(range(len(t))) AS BIGINT) AS idx, round(CAST(unnest(t) AS DOUBLE), 6) AS value FROM a"""

SQL["zero_vector_fallback"] = f"""WITH d AS (SELECT doc_id, {letters('text')} AS s FROM documents)
SELECT doc_id, CASE WHEN length(s) >= 3 THEN CAST(len({ngram_buckets('s')}) AS BIGINT) ELSE 0 END AS n_set,
       length(s) < 3 AS rejected FROM d"""

SQL["hashed_fingerprint"] = f"""WITH d AS (SELECT doc_id, {letters('text')} AS s FROM documents),
b AS (SELECT doc_id, CASE WHEN length(s) >= 3 THEN {ngram_buckets('s')} ELSE []::BIGINT[] END AS bk FROM d)
SELECT doc_id, CAST(len(bk) AS BIGINT) AS n_bits, {lsum('bk')} AS bit_sum FROM b"""

SQL["char_tokenize"] = f"""WITH t AS (SELECT doc_id, {TOK} AS ids FROM documents)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, {lsum('ids')} AS id_sum, {wsum('ids')} AS id_wsum FROM t"""

SQL["residue_ids"] = f"""WITH t AS (SELECT doc_id, {RES} AS ids FROM documents)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n, {lsum('ids')} AS id_sum, {wsum('ids')} AS id_wsum FROM t"""

SQL["eval_cadence"] = f"""WITH {EPOCHS} SELECT run_id, epoch, round(v, 6) AS v FROM epochs WHERE epoch % 5 = 0"""

SQL["pos_neg_union"] = f"""WITH {EDGES} SELECT row_id, p0, p1, label FROM edges"""

SQL["distinct_keys"] = f"""WITH {EDGES} SELECT DISTINCT key FROM (SELECT p0 AS key FROM edges UNION ALL SELECT p1 FROM edges)"""

SQL["split_union"] = f"""WITH {EDGES}
SELECT split, count(*) AS n_rows, count(DISTINCT p0) AS n_keys FROM edges GROUP BY split"""

SQL["split_union_rows"] = f"""WITH {EDGES}
SELECT row_id, p0, p1, label, split FROM edges"""

SQL["split_sizes"] = f"""WITH {SPLITS}
SELECT split, count(*) AS n_rows, count(DISTINCT target) AS n_keys FROM srows WHERE split IS NOT NULL GROUP BY split"""

SQL["assign_batches"] = f"""WITH {PAIRS}
SELECT row_id, CAST((row_number() OVER (ORDER BY {HASH_ORDER.format(x='row_id')}, row_id) - 1) // 32 AS BIGINT) AS batch_id
FROM pairs"""

SQL["seeded_shuffle"] = f"""SELECT doc_id, CAST(row_number() OVER (ORDER BY {HASH_ORDER.format(x='doc_id')}, doc_id) - 1 AS BIGINT) AS position
FROM documents"""

SQL["pad_batch"] = f"""WITH {TOKENS},
s AS (SELECT seq_id, count(*) AS n FROM tokens GROUP BY seq_id),
b AS (SELECT seq_id, n, CAST((row_number() OVER (ORDER BY {HASH_ORDER.format(x='seq_id')}, seq_id) - 1) // 4 AS BIGINT) AS batch_id FROM s),
slots AS (SELECT batch_id, seq_id, CAST(unnest(range((SELECT max(n) FROM b b2 WHERE b2.batch_id = b.batch_id))) AS BIGINT) AS pos FROM b),
padded AS (SELECT slots.batch_id, slots.seq_id, slots.pos, CAST(d.d AS BIGINT) AS dim,
                  coalesce(CAST(t.vec[d.d + 1] AS DOUBLE), 20.0::DOUBLE) AS value
           FROM slots LEFT JOIN tokens t ON slots.seq_id = t.seq_id AND slots.pos = t.pos, range(64) d(d))
SELECT batch_id, seq_id, pos, dim, round(value, 6) AS value FROM padded"""

SQL["sentinel_mask"] = SQL["pad_batch"].rsplit("SELECT batch_id, seq_id, pos, dim", 1)[0] + """SELECT batch_id, seq_id, pos,
  CAST(max(CASE WHEN value <> 20.0::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS valid_any,
  CAST(max(CASE WHEN dim = 0 AND value <> 20.0::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS valid_first
FROM padded GROUP BY batch_id, seq_id, pos"""

FIRST_APPEAR = """fa AS (SELECT target, min(doc_id) AS first FROM srows WHERE split = 'train' GROUP BY target),
idx AS (SELECT target, CAST(row_number() OVER (ORDER BY first, target) - 1 AS BIGINT) AS idx FROM fa)"""

SQL["first_appearance_index"] = f"""WITH {SPLITS}, {FIRST_APPEAR} SELECT target, idx FROM idx"""

SQL["label_map_join"] = f"""WITH {SPLITS}, {FIRST_APPEAR}
SELECT srows.doc_id, srows.split, srows.target, idx.idx FROM srows LEFT JOIN idx ON srows.target = idx.target"""

SQL["group_holdout_split"] = """SELECT doc_id, source,
  CASE WHEN ('0x' || substr(md5('12345|' || source || '|' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.2::DOUBLE
       THEN 'valid' ELSE 'train' END AS part FROM documents"""

# ---------------------------------------------------------------------------------- joins

VSUM = "round(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE))), 6)"



def key_vectors(source: str) -> str:
    """kv: (key, i, x) of the hash encoder, 64 wide, for the distinct keys of ``source`` (one column, key)."""
    return f"""kk AS (SELECT DISTINCT CAST(key AS VARCHAR) AS key FROM ({source})),
kv AS (SELECT kk.key, CAST(g.i AS BIGINT) AS i,
              CAST(CAST(('0x' || substr(md5(kk.key || '|' || CAST(g.i AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS FLOAT) AS DOUBLE) AS x
       FROM kk, range(64) g(i)),
kl AS (SELECT key, list(x ORDER BY i) AS vec, sum(x) AS total FROM kv GROUP BY key)"""


LINE_KEYS = "SELECT l_partkey AS key FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem"

SQL["pair_feature_join"] = f"""WITH {PAIRS},
{key_vectors(LINE_KEYS)}
SELECT p.row_id, p.drug_key, p.target_key, p.label, round(a.total, 6) AS drug_sum, round(b.total, 6) AS target_sum
FROM pairs p LEFT JOIN kl a ON CAST(p.drug_key AS VARCHAR) = a.key LEFT JOIN kl b ON CAST(p.target_key AS VARCHAR) = b.key"""

SQL["entity_feature_join"] = f"""WITH {SPLITS},
{key_vectors("SELECT doc_id AS key FROM documents")}
SELECT s.doc_id, s.target, round(k.total, 6) AS vec_sum FROM splits s LEFT JOIN kl k ON CAST(s.doc_id AS VARCHAR) = k.key"""

SQL["edge_feature_selfjoin"] = f"""WITH {EDGES},
{key_vectors(LINE_KEYS)}
SELECT x.row_id, x.label, round(a.total, 6) AS p0_sum, round(b.total, 6) AS p1_sum
FROM edges x LEFT JOIN kl a ON x.p0 = a.key LEFT JOIN kl b ON x.p1 = b.key"""

SQL["unresolved_pair_keys"] = f"""WITH {PAIRS}
SELECT drug_key AS key, count(*) AS n_rows FROM pairs WHERE drug_key NOT IN (SELECT vec_id FROM embeddings) GROUP BY drug_key"""

RESOLVED = f"""{EDGES},
ids AS (SELECT DISTINCT acc FROM (SELECT p0 AS acc FROM edges UNION ALL SELECT p1 FROM edges)),
r AS (SELECT ids.acc, d.s AS ps, pg.url AS fs FROM ids
      LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS acc, text AS s FROM documents) d ON ids.acc = d.acc
      LEFT JOIN (SELECT CAST(page_id AS VARCHAR) AS acc, url FROM pages) pg ON ids.acc = pg.acc)"""

SQL["resolve_accession"] = f"""WITH {RESOLVED}
SELECT acc, CASE WHEN ps IS NOT NULL THEN 'primary' WHEN fs IS NOT NULL THEN 'fallback' END AS source,
       CAST(length(coalesce(ps, fs)) AS BIGINT) AS seq_len FROM r"""

SQL["unresolved_accession"] = f"""WITH {RESOLVED} SELECT acc FROM r WHERE ps IS NULL AND fs IS NULL"""

SQL["membership_semi"] = f"""WITH {MLAB}, {MEMBERS}
SELECT CAST(protein AS VARCHAR) AS protein, label FROM mlab
WHERE CAST(protein AS VARCHAR) IN (SELECT protein FROM members WHERE p50 = '1')"""

SQL["missing_keys_anti"] = f"""WITH {PAIRS}
SELECT DISTINCT drug_key FROM pairs WHERE drug_key NOT IN (SELECT vec_id FROM embeddings)"""

ANNOT = """ev AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
annot AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS protein,
                 list_filter(string_split(CASE WHEN k % 10 = 0 THEN ''
                                               WHEN k % 4 = 0 THEN event_type || ',k' || CAST(k % 7 AS VARCHAR) || ',' || event_type
                                               ELSE event_type || ',k' || CAST(k % 7 AS VARCHAR) END, ','), lambda x: x <> '') AS codes
          FROM ev),
vocab AS (SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS BIGINT) AS idx FROM
          (SELECT DISTINCT event_type AS code FROM events UNION SELECT 'k' || CAST(range AS VARCHAR) FROM range(8))),
ex AS (SELECT protein, CAST(unnest(range(len(codes))) AS BIGINT) AS pos, unnest(codes) AS code FROM annot)"""

SQL["annotation_scan"] = f"""WITH {ANNOT} SELECT protein, pos, code FROM ex"""

SQL["annotation_join"] = f"""WITH {ANNOT}
SELECT 'e' || CAST(e.event_id AS VARCHAR) AS protein, CAST(len(a.codes) AS BIGINT) AS n_codes
FROM events e JOIN annot a ON 'e' || CAST(e.event_id AS VARCHAR) = a.protein WHERE e.event_type <> 'error'"""

SQL["annotation_quarantine"] = """SELECT 'e' || CAST(event_id AS VARCHAR) AS protein FROM events WHERE event_type = 'error'"""

SQL["code_index_join"] = f"""WITH {ANNOT} SELECT ex.protein, ex.pos, ex.code, vocab.idx FROM ex LEFT JOIN vocab ON ex.code = vocab.code"""

SQL["label_frequency"] = f"""WITH {ANNOT},
f AS (SELECT code, count(*) AS freq FROM ex GROUP BY code)
SELECT vocab.code, vocab.idx, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq FROM vocab LEFT JOIN f ON vocab.code = f.code"""

SQL["class_weights"] = f"""WITH {ANNOT},
f AS (SELECT code, count(*) AS freq FROM ex GROUP BY code),
lf AS (SELECT vocab.code, vocab.idx, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq FROM vocab LEFT JOIN f ON vocab.code = f.code)
SELECT code, idx, freq, round((SELECT count(DISTINCT protein) FROM annot)::DOUBLE / nullif(freq, 0)::DOUBLE, 6) AS weight FROM lf"""

SQL["multi_hot"] = f"""WITH {ANNOT}
SELECT annot.protein, vocab.idx, CASE WHEN list_contains(annot.codes, vocab.code) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value
FROM annot, vocab"""

SQL["align_pred_label"] = f"""WITH {REG_ID} SELECT row_id, round(p, 6) AS p, round(y, 6) AS y FROM reg"""

FASTA_BODY = letters("regexp_replace(text, '[\\s>]+', '', 'g')")

SQL["fasta_records"] = f"""SELECT CAST(doc_id AS VARCHAR) AS acc, {FASTA_BODY} AS seq FROM documents"""

SQL["fasta_lines"] = f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) || ' ' || lang AS name,
                   regexp_extract_all({FASTA_BODY}, '.{{1,60}}') AS ch FROM documents)
SELECT name, CAST(unnest(range(len(ch))) AS BIGINT) AS line_no, unnest(ch) AS seq FROM c"""

# ---------------------------------------------------------------------------------- vector functions, heads

FDIMS = """fdims AS (SELECT vec_id AS key, CAST(unnest(range(len(embedding))) AS BIGINT) AS i,
                       CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def wmat(name: str, n_out: int, n_in: int = 64, offset: int = 0) -> str:
    return f"""{name} AS (SELECT o.o AS o, i.i AS i, ((o.o * 13 + i.i * 7 + {offset}) % 19 - 9) / 90.0::DOUBLE AS w
        FROM range({n_out}) o(o), range({n_in}) i(i))"""


Z8 = f"""{FDIMS},
{wmat('w8', 8)},
z AS (SELECT fdims.key, w8.o, sum(w8.w * fdims.x) + w8.o / 10.0::DOUBLE AS z FROM fdims JOIN w8 ON fdims.i = w8.i GROUP BY fdims.key, w8.o)"""

SQL["linspace_points"] = f"""WITH {TOKENS},
n AS (SELECT seq_id, count(*) AS n FROM tokens GROUP BY seq_id),
x AS (SELECT seq_id, n, CAST(unnest(range(1, n + 1)) AS BIGINT) AS i FROM n)
SELECT seq_id, i, round(i / (n + 1.0::DOUBLE), 6) AS x FROM x"""

SQL["unit_slices"] = f"""WITH {FDIMS}
SELECT key, i AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY key)), 6) AS value FROM fdims"""

SQL["linear_projection"] = f"""WITH {Z8} SELECT key, o, round(z, 6) AS value FROM z"""

SQL["activations"] = f"""WITH {Z8}
SELECT key, o, round(greatest(z, 0.0::DOUBLE), 6) AS relu, round(CASE WHEN z > 0 THEN z ELSE exp(z) - 1.0::DOUBLE END, 6) AS elu,
       round(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)), 6) AS sigmoid, round(CASE WHEN z >= 0 THEN z ELSE 0.2::DOUBLE * z END, 6) AS leaky_relu
FROM z"""

SQL["logistic"] = f"""WITH {PREDS}
SELECT row_id, round(least(greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(-10.0::DOUBLE * (score - 0.5::DOUBLE))), 0.0::DOUBLE), 1.0::DOUBLE), 6) AS value
FROM preds"""

PAIRV = f"""{PAIRS},
{key_vectors(LINE_KEYS)},
pv AS (SELECT p.row_id, a.vec AS a, b.vec AS b
       FROM pairs p LEFT JOIN kl a ON CAST(p.drug_key AS VARCHAR) = a.key LEFT JOIN kl b ON CAST(p.target_key AS VARCHAR) = b.key)"""

COS = """least(greatest(list_inner_product({a}, {b}) / (greatest(sqrt(list_inner_product({a}, {a})), 1e-8::DOUBLE)
        * greatest(sqrt(list_inner_product({b}, {b})), 1e-8::DOUBLE)), -1.0::DOUBLE), 1.0::DOUBLE)"""

SQL["cosine_scores"] = f"""WITH {PAIRV}
SELECT row_id, round({COS.format(a='a', b='b')}, 6) AS cosine, round(pow({COS.format(a='a', b='b')}, 2), 6) AS sq_cosine FROM pv"""

SQL["euclidean_scores"] = f"""WITH {PAIRV}
SELECT row_id, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) * (a[k] - b[k])))), 6) AS euclidean,
       round(list_sum(list_transform(range(1, len(a) + 1), lambda k: (a[k] - b[k]) * (a[k] - b[k]))), 6) AS sq_euclidean FROM pv"""

SQL["inner_product"] = f"""WITH {PAIRV} SELECT row_id, round(list_inner_product(a, b), 6) AS inner FROM pv"""

SQL["masked_softmax"] = f"""WITH {TOKENS},
{TOKEN_DIMS},
m AS (SELECT seq_id, dim, max(x) AS mx FROM tdims GROUP BY seq_id, dim),
e AS (SELECT t.seq_id, t.pos, t.dim, exp(t.x - m.mx) AS e FROM tdims t JOIN m ON t.seq_id = m.seq_id AND t.dim = m.dim)
SELECT seq_id, pos, dim, round(e / sum(e) OVER (PARTITION BY seq_id, dim), 6) AS value FROM e"""

SQL["masked_softmax_padded"] = SQL["pad_batch"].rsplit("SELECT batch_id, seq_id, pos, dim", 1)[0] + """SELECT seq_id, pos, dim,
  round(CASE WHEN value = 20.0::DOUBLE THEN 0.0::DOUBLE ELSE exp(value) END
        / sum(CASE WHEN value = 20.0::DOUBLE THEN 0.0::DOUBLE ELSE exp(value) END) OVER (PARTITION BY seq_id, dim), 6) AS value FROM padded"""

SQL["batch_norm"] = f"""WITH {FDIMS},
s AS (SELECT i, avg(x) AS mu, var_pop(x) AS va FROM fdims GROUP BY i)
SELECT fdims.key, fdims.i AS dim, round((fdims.x - s.mu) / sqrt(s.va + 1e-5::DOUBLE), 6) AS value FROM fdims JOIN s ON fdims.i = s.i"""

SQL["step_counter"] = f"""WITH {EPOCHS},
b AS (SELECT CAST(ceil(count(*) / 32.0::DOUBLE) AS BIGINT) AS b FROM lineitem),
x AS (SELECT run_id, epoch, b, CAST(unnest(range(b)) AS BIGINT) AS i FROM epochs, b)
SELECT run_id, epoch, i, CAST(epoch * b * 32 + i * 32 AS BIGINT) AS step FROM x"""

SQL["linspace_reference"] = f"""WITH {TOKENS},
n AS (SELECT seq_id, count(*) AS n FROM tokens GROUP BY seq_id),
x AS (SELECT seq_id, n, CAST(unnest(range(n)) AS BIGINT) AS i FROM n)
SELECT seq_id, i, round(CASE WHEN n = 1 THEN -1.0::DOUBLE ELSE (i * 1.0::DOUBLE - (n - 1 - i)) / (n - 1) END, 6) AS x FROM x"""

SQL["run_summary"] = f"""WITH {EPOCHS},
s AS (SELECT *, date_diff('microsecond', t_start, t_end) / 1e6::DOUBLE AS sec FROM epochs)
SELECT run_id, count(*) AS n_epochs, round(avg(sec / 5.0::DOUBLE), 6) AS epoch_time,
       round(date_diff('microsecond', min(t_start), max(t_end)) / 1e6::DOUBLE, 6) AS wall_clock,
       round(arg_max(sec, epoch), 6) AS eval_time FROM s GROUP BY run_id"""

SQL["checkpoint_events"] = f"""WITH {EPOCHS},
p AS (SELECT run_id, epoch, v, greatest(coalesce(max(v) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE), 0.0::DOUBLE) AS prev FROM epochs)
SELECT run_id, epoch, round(v, 6) AS v FROM p WHERE v > prev"""

SQL["best_epoch"] = f"""WITH {EPOCHS}
SELECT run_id, first(epoch ORDER BY v DESC, epoch ASC) AS best_epoch, round(max(v), 6) AS best_v FROM epochs GROUP BY run_id"""

SQL["cosine_restart_lr"] = f"""WITH {EPOCHS}
SELECT run_id, epoch, round(1e-4::DOUBLE / 2.0::DOUBLE * (1.0::DOUBLE + cos(pi() * (epoch % 10) / 10.0::DOUBLE)) * 1e6::DOUBLE, 6) AS lr_e6 FROM epochs"""


def hidden(name: str, offset: int, act: str = "greatest({z}, 0.0::DOUBLE)") -> str:
    return f"""{wmat('w' + name, 8, 64, offset)},
y{name} AS (SELECT kv.key, w{name}.o, sum(w{name}.w * kv.x) AS z
            FROM kv JOIN w{name} ON kv.i = w{name}.i GROUP BY kv.key, w{name}.o),
z{name} AS (SELECT key, o, {act.format(z='z')} AS h FROM y{name}),
h{name} AS (SELECT key, list(h ORDER BY o) AS h FROM z{name} GROUP BY key)"""


SQL["score_pairs_cosine"] = f"""WITH {PAIRS},
{key_vectors(LINE_KEYS)},
{hidden('d', 0)},
{hidden('t', 5)}
SELECT p.row_id, round({COS.format(a='hd.h', b='ht.h')}, 6) AS score
FROM pairs p LEFT JOIN hd ON CAST(p.drug_key AS VARCHAR) = hd.key LEFT JOIN ht ON CAST(p.target_key AS VARCHAR) = ht.key"""


def erf(x: str) -> str:
    """Taylor sum and asymptotic continued fraction, written as list sums."""
    near = (f"2.0::DOUBLE / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: "
            f"(CASE WHEN n % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * pow({x}, 2 * n + 1) / (factorial(CAST(least(n, 20) AS INTEGER))"
            f" * list_product(list_transform(range(21, greatest(n + 1, 21)), lambda k: CAST(k AS DOUBLE)) || [1.0::DOUBLE]) * (2 * n + 1))))")
    return near


GELU = "0.5::DOUBLE * {z} * (1.0::DOUBLE + " + erf("({z} / sqrt(2.0::DOUBLE))") + ")"

for _name, _act in (("score_pairs_inner", "greatest({z}, 0.0::DOUBLE)"), ("score_pairs_gelu", GELU)):
    SQL[_name] = f"""WITH {PAIRS},
{key_vectors(LINE_KEYS)},
{hidden('d', 0, _act)},
{hidden('t', 5, _act)}
SELECT p.row_id, round(list_inner_product(hd.h, ht.h), 6) AS score
FROM pairs p LEFT JOIN hd ON CAST(p.drug_key AS VARCHAR) = hd.key LEFT JOIN ht ON CAST(p.target_key AS VARCHAR) = ht.key"""

SQL["gelu"] = f"""WITH {Z8} SELECT key, o, round({GELU.format(z='z')}, 6) AS gelu FROM z"""

SQL["score_edges"] = f"""WITH {EDGES},
{key_vectors(LINE_KEYS)},
{hidden('d', 0)}
SELECT x.row_id, round({COS.format(a='a.h', b='b.h')}, 6) AS score
FROM edges x LEFT JOIN hd a ON x.p0 = a.key LEFT JOIN hd b ON x.p1 = b.key"""

SQL["score_classes"] = f"""WITH {EMB_LOGITS}
SELECT vec_id, CAST(first(o ORDER BY z DESC, o ASC) AS BIGINT) AS pred FROM lg GROUP BY vec_id"""

SQL["score_multilabel"] = f"""WITH {FDIMS},
{wmat('w1', 16, 64, 0)},
{wmat('w2', 10, 16, 3)},
h0 AS (SELECT key, i, CASE WHEN x / sqrt(1.0::DOUBLE + 1e-5::DOUBLE) >= 0 THEN x / sqrt(1.0::DOUBLE + 1e-5::DOUBLE)
                          ELSE 0.2::DOUBLE * x / sqrt(1.0::DOUBLE + 1e-5::DOUBLE) END AS h FROM fdims),
h1 AS (SELECT h0.key, w1.o AS i, sum(w1.w * h0.h) / sqrt(1.0::DOUBLE + 1e-5::DOUBLE) AS a FROM h0 JOIN w1 ON h0.i = w1.i GROUP BY h0.key, w1.o),
h1l AS (SELECT key, i, CASE WHEN a >= 0 THEN a ELSE 0.2::DOUBLE * a END AS h FROM h1)
SELECT h1l.key, CAST(w2.o AS BIGINT) AS label, round(sum(w2.w * h1l.h), 6) AS logit FROM h1l JOIN w2 ON h1l.i = w2.i GROUP BY h1l.key, w2.o"""

SQL["score_multilabel_batches"] = SQL["score_multilabel"]

SQL["pool_dispatch"] = f"""SELECT 'avg' AS method, seq_id, dim AS idx, value FROM ({SQL['pool_avg']})
UNION ALL SELECT 'max', seq_id, dim, value FROM ({SQL['pool_max']})
UNION ALL SELECT 'topk', seq_id, dim, value FROM ({SQL['pool_topk']})
UNION ALL SELECT 'swe', seq_id, slice, value FROM ({SQL['pool_swe']})"""

SQL["evaluate_dispatch"] = f"""SELECT 'micro_auprc' AS metric, micro_auprc AS value FROM ({SQL['metric_micro_auprc']})
UNION ALL SELECT 'micro_auroc', micro_auroc FROM ({SQL['metric_micro_auroc']})
UNION ALL SELECT 'f1_max', f1_max FROM ({SQL['metric_f1_max']})"""

# ---------------------------------------------------------------------------------- store, sinks, encoder host

HASH8 = "('0x' || substr(md5({s} || '|' || CAST(g.i AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"

SQL["encode_distinct"] = f"""SELECT d.doc_id, CAST(g.i AS BIGINT) AS dim, round(CAST(CAST({HASH8.format(s='d.text')} AS FLOAT) AS DOUBLE), 6) AS value
FROM documents d, range(8) g(i)"""

VEC8SUM = f"""(SELECT round(sum(CAST(CAST({HASH8.format(s='{s}')} AS FLOAT) AS DOUBLE)), 6) FROM range(8) g(i))"""

SQL["feature_store_roundtrip"] = f"""SELECT md5(key) AS key_md5, 'hash8' AS model, {VEC8SUM.format(s='key')} AS vec_sum
FROM (SELECT DISTINCT text AS key FROM documents)"""

SQL["feature_store_fallback"] = f"""SELECT doc_id,
  CASE WHEN text IN (SELECT text FROM benchmark) THEN 'store' ELSE 'encoded' END AS source, {VEC8SUM.format(s='text')} AS vec_sum
FROM documents"""

SQL["metrics_sink"] = f"""WITH {EPOCHS}
SELECT run_id, epoch, 'val/v' AS metric, round(v, 6) AS value FROM epochs
UNION ALL SELECT run_id, epoch, 'charts/epoch_time', round(date_diff('microsecond', t_start, t_end) / 1e6::DOUBLE, 6) FROM epochs"""


def plateau(mode: str) -> str:
    """The scheduler as a recursive query: one step per epoch and run."""
    start, better = ("'Infinity'", "n.v < f.best * (1.0::DOUBLE - 1e-4::DOUBLE)") if mode == "min" else (
        "'-Infinity'", "n.v > f.best * (1.0::DOUBLE + 1e-4::DOUBLE)")
    return f"""f_{mode} AS (
  SELECT run_id, 0::BIGINT AS rn, NULL::BIGINT AS epoch, {start}::DOUBLE AS best, 0 AS bad, 1e-3::DOUBLE AS lr FROM (SELECT DISTINCT run_id FROM epochs)
  UNION ALL
  SELECT n.run_id, n.rn, n.epoch, CASE WHEN {better} THEN n.v ELSE f.best END,
         CASE WHEN {better} THEN 0 WHEN f.bad + 1 > 5 THEN 0 ELSE f.bad + 1 END,
         CASE WHEN NOT ({better}) AND f.bad + 1 > 5 THEN greatest(f.lr * 0.6::DOUBLE, 0.0::DOUBLE) ELSE f.lr END
  FROM f_{mode} f JOIN numbered n ON n.run_id = f.run_id AND n.rn = f.rn + 1)"""


SQL["plateau_schedule"] = f"""WITH RECURSIVE {EPOCHS},
numbered AS (SELECT run_id, epoch, v, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rn FROM epochs),
{plateau('min')},
{plateau('max')}
SELECT run_id, 'min' AS mode, epoch, round(lr * 1e6::DOUBLE, 6) AS lr_e6 FROM f_min WHERE rn > 0
UNION ALL SELECT run_id, 'max', epoch, round(lr * 1e6::DOUBLE, 6) FROM f_max WHERE rn > 0"""

# ---------------------------------------------------------------------------------- along the positions, files, streams


def conv(name: str, offset: int) -> str:
    """``name``: (seq_id, pos, o, y) of the zero-padded width-5 convolution."""
    return f"""{name} AS (
  SELECT t.seq_id, t.pos, o.o, o.o / 10.0::DOUBLE + sum(((o.o * 5 + x.dim * 3 + (x.pos - t.pos + 2) * 7 + {offset}) % 11 - 5) / 10.0::DOUBLE * x.x) AS y
  FROM (SELECT DISTINCT seq_id, pos FROM nd) t JOIN nd x ON t.seq_id = x.seq_id AND abs(x.pos - t.pos) <= 2, range(64) o(o)
  GROUP BY t.seq_id, t.pos, o.o)"""


NARROW = f"""{TOKENS},
{TOKEN_DIMS},
nd AS (SELECT * FROM tdims)"""

SQL["conv1d_same"] = f"""WITH {NARROW},
{conv('c', 0)}
SELECT seq_id, pos, CAST(o AS BIGINT) AS dim, round(y, 6) AS value FROM c"""

SQL["pool_light_attn"] = f"""WITH {NARROW},
{conv('v', 0)},
{conv('a', 4)},
m AS (SELECT seq_id, o, max(y) AS top FROM a GROUP BY seq_id, o),
s AS (SELECT v.seq_id, v.o, max(v.y) AS most, sum(exp(a.y - m.top) * v.y) / sum(exp(a.y - m.top)) AS att
      FROM v JOIN a ON v.seq_id = a.seq_id AND v.pos = a.pos AND v.o = a.o JOIN m ON m.seq_id = v.seq_id AND m.o = v.o GROUP BY v.seq_id, v.o),
f AS (SELECT seq_id, o AS i, most AS x FROM s UNION ALL SELECT seq_id, o + 64, att FROM s)
SELECT f.seq_id, CAST(j.j AS BIGINT) AS idx, round(j.j / 10.0::DOUBLE + sum(((j.j * 13 + f.i * 7) % 19 - 9) / 90.0::DOUBLE * f.x), 6) AS value
FROM f, range(64) j(j) GROUP BY f.seq_id, j.j"""

SQL["pool_dispatch"] += f"\nUNION ALL SELECT 'light_attn', seq_id, idx, value FROM ({SQL['pool_light_attn']})"

SQL["pool_swe_ranges"] = SQL["pool_swe"]

# Knots of the padded batch built one by one: real ones at i / (n + 1), the k-th padded one 0.001 k beyond, on the last line.
SQL["pool_swe_masked"] = SQL["pad_batch"].rsplit("SELECT batch_id, seq_id, pos, dim", 1)[0].rstrip() + f""",
{theta_cte()},
{ref_cte()},
ok AS (SELECT seq_id, pos, max(CASE WHEN dim = 0 AND value <> 20.0::DOUBLE THEN 1 ELSE 0 END) = 1 AS ok FROM padded GROUP BY seq_id, pos),
pr AS (SELECT p.seq_id, p.pos, th.l AS slice, sum(p.value * th.t) AS p FROM padded p JOIN th ON p.dim = th.d GROUP BY ALL),
real AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.seq_id, slice ORDER BY p, pr.pos) AS i, count(*) OVER (PARTITION BY pr.seq_id, slice) AS n
         FROM pr JOIN ok ON ok.seq_id = pr.seq_id AND ok.pos = pr.pos WHERE ok.ok),
ends AS (SELECT seq_id, slice, any_value(n) AS n, max(CASE WHEN i = n THEN p END) AS top, max(CASE WHEN i = n - 1 THEN p END) AS next FROM real GROUP BY seq_id, slice),
pad AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS k FROM ok WHERE NOT ok.ok),
knots AS (SELECT seq_id, slice, i, i / (n + 1.0::DOUBLE) AS x, p AS y FROM real
          UNION ALL
          SELECT e.seq_id, e.slice, e.n + k, e.n / (e.n + 1.0::DOUBLE) + 0.001::DOUBLE * k,
                 CASE WHEN e.n = 1 THEN top ELSE top + (top - next) * (e.n + 1) * 0.001::DOUBLE * k END
          FROM ends e JOIN pad ON pad.seq_id = e.seq_id),
kn AS (SELECT *, count(*) OVER (PARTITION BY seq_id, slice) AS n FROM knots),
size AS (SELECT DISTINCT seq_id, slice, n FROM kn),
pts AS (SELECT size.*, refpts.r, refpts.w, (refpts.a + 1) / {SWE_M + 1}.0::DOUBLE AS t FROM size JOIN refpts ON refpts.slice = size.slice),
placed AS (SELECT pts.*, (SELECT count(*) FROM kn WHERE kn.seq_id = pts.seq_id AND kn.slice = pts.slice AND kn.x < pts.t) AS below FROM pts),
seg AS (SELECT *, greatest(least(below, n - 1), 1) AS i FROM placed)
SELECT seg.seq_id, CAST(seg.slice AS BIGINT) AS slice,
       round(sum(w * (r - CASE WHEN seg.n = 1 THEN a.y ELSE a.y + (b.y - a.y) / (1.1920929e-07::DOUBLE + (b.x - a.x)) * (t - a.x) END)), 6) AS value
FROM seg JOIN kn a ON a.seq_id = seg.seq_id AND a.slice = seg.slice AND a.i = seg.i
         LEFT JOIN kn b ON b.seq_id = seg.seq_id AND b.slice = seg.slice AND b.i = seg.i + 1
GROUP BY seg.seq_id, seg.slice"""

SQL["invalid_shift"] = SQL["pad_batch"].rsplit("SELECT batch_id, seq_id, pos, dim", 1)[0] + """SELECT batch_id, seq_id, pos,
  round(0.001::DOUBLE * sum(CASE WHEN value = 20.0::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos), 6) AS shift
FROM padded WHERE dim = 0"""

SQL["reference_argsort"] = f"""WITH e AS (SELECT CAST(label AS BIGINT) AS m, CAST(unnest(range(len(embedding))) AS BIGINT) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
mean AS (SELECT m, d, avg(x) AS x FROM e GROUP BY m, d),
{theta_cte()},
p AS (SELECT mean.m, th.l AS slice, sum(mean.x * th.t) AS p FROM mean JOIN th ON mean.d = th.d GROUP BY mean.m, th.l)
SELECT CAST(slice AS BIGINT) AS slice, m, CAST(row_number() OVER (PARTITION BY slice ORDER BY p, m) - 1 AS BIGINT) AS rank FROM p"""

SQL["interp1d"] = f"""WITH {TOKENS},
t AS (SELECT seq_id, pos, CAST(vec[1] AS DOUBLE) AS x, CAST(vec[2] AS DOUBLE) AS y FROM tokens),
k AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY x, pos) - 1 AS i, count(*) OVER (PARTITION BY seq_id) AS n FROM t),
r AS (SELECT seq_id, min(x) AS lo, max(x) AS hi, any_value(n) AS n FROM k GROUP BY seq_id),
q AS (SELECT seq_id, n, j.j AS j, lo - 0.5::DOUBLE + j.j * (hi - lo + 1.0::DOUBLE) / 8.0::DOUBLE AS q FROM r, range(9) j(j)),
b AS (SELECT q.seq_id, q.n, q.j, q.q, (SELECT count(*) FROM k WHERE k.seq_id = q.seq_id AND k.x < q.q) AS below FROM q),
c AS (SELECT *, least(greatest(below - 1, 0), n - 2) AS i FROM b)
SELECT c.seq_id, CAST(c.j AS BIGINT) AS j,
       round(CASE WHEN c.n = 1 THEN z.y ELSE a.y + (d.y - a.y) / (1.1920929e-07::DOUBLE + (d.x - a.x)) * (c.q - a.x) END, 6) AS y
FROM c LEFT JOIN k a ON a.seq_id = c.seq_id AND a.i = c.i LEFT JOIN k d ON d.seq_id = c.seq_id AND d.i = c.i + 1
       LEFT JOIN k z ON z.seq_id = c.seq_id AND z.i = 0"""

SQL["concat_features"] = """SELECT doc_id, CAST(g.i AS BIGINT) AS dim,
  round(CAST(CAST(('0x' || substr(md5(CASE WHEN g.i < 8 THEN source || '|' || CAST(g.i AS VARCHAR) ELSE 's:' || source || '|' || CAST(g.i - 8 AS VARCHAR) END), 1, 8))::BIGINT
        / 4294967296.0::DOUBLE AS FLOAT) AS DOUBLE), 6) AS value
FROM documents, range(12) g(i)"""

SQL["scan_split_csv"] = f"WITH {EDGES} SELECT row_id, p0, p1, label, split FROM edges"
SQL["scan_flagged_csv"] = f"""WITH {SPLITS}
SELECT splits.doc_id, md5(splits.sequence) AS sequence_md5, srows.split FROM splits JOIN srows ON splits.doc_id = srows.doc_id"""
SQL["scan_edge_lists"] = f"WITH {EDGES} SELECT p0, p1, label, split, count(*) AS n FROM edges GROUP BY ALL"
SQL["scan_fasta"] = SQL["fasta_records"]
SQL["scan_fasta_lines"] = SQL["fasta_lines"]
SQL["scan_annotation_tsv"] = SQL["code_index_join"]
SQL["scan_membership"] = SQL["identity_filter"]
SQL["stream_featurize"] = SQL["feature_store_roundtrip"]
SQL["stream_metrics"] = f"""WITH {LINE_PREDS}
SELECT count(*) FILTER (WHERE score > 0.5::DOUBLE AND label = 1) AS tp, count(*) FILTER (WHERE score > 0.5::DOUBLE AND label <> 1) AS fp,
       count(*) FILTER (WHERE NOT score > 0.5::DOUBLE AND label = 1) AS fn, count(*) FILTER (WHERE NOT score > 0.5::DOUBLE AND label <> 1) AS tn,
       round(avg((score - label) * (score - label)), 6) AS mse FROM lp"""

SQL["stream_rank_metrics"] = f"""WITH {LINE_PREDS},
{ap_sql('lp', 'score', 'label')}
SELECT round(sum(tp * ctp / (ctp + cfp)) / max(ttp), 6) AS average_precision,
       round(sum(fp * (2 * ctp - tp)) / 2.0::DOUBLE / nullif(max(ttp) * max(tfp), 0), 6) AS auroc FROM cc"""

_POOLED = f"""{PAIRS},
tokens AS (SELECT l_suppkey AS seq_id, row_number() OVER () AS pos,
                  [l_quantity / 50.0::DOUBLE, l_extendedprice / 100000.0::DOUBLE, l_discount * 10.0::DOUBLE, l_tax * 10.0::DOUBLE] AS vec FROM lineitem),
{TOKEN_DIMS},
{theta_cte(8, 4)},
{proj_cte()},
{SORTED},
{ref_cte(SWE_M, 8)},
qs AS (SELECT sv.seq_id, sv.slice, refpts.m, refpts.r, refpts.w, refpts.a + 1 AS j, sv.v, sv.n FROM sv JOIN refpts ON sv.slice = refpts.slice),
gap AS (SELECT seq_id, slice, m, w, r - ({quantile_sql()}) AS gap FROM qs),
kp AS (SELECT CAST(seq_id AS VARCHAR) AS key, slice AS i, sum(w * gap) AS x FROM gap GROUP BY 1, 2),
{key_vectors('SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS key FROM lineitem')},
{hidden('d', 0)},
{hidden('t', 5).replace('kv', 'kp').replace('range(64)', 'range(8)')}"""

SQL["score_pairs_pooled"] = f"""WITH {_POOLED}
SELECT p.row_id, round({COS.format(a='hd.h', b='ht.h')}, 6) AS score
FROM pairs p LEFT JOIN hd ON CAST(p.drug_key AS VARCHAR) = hd.key LEFT JOIN ht ON CAST(p.target_key AS VARCHAR) = ht.key"""

# Loss of the pooled pairs, and its gradient by the weights of the reference points: through cosine, projector and pooling.
SQL["fit_pair_start"] = f"""WITH {_POOLED},
pp AS (SELECT p.target_key AS seq_id, p.label AS y, hd.h AS a, ht.h AS b, greatest(sqrt(list_inner_product(hd.h, hd.h)), 1e-8::DOUBLE) AS na,
              greatest(sqrt(list_inner_product(ht.h, ht.h)), 1e-8::DOUBLE) AS nb, list_inner_product(hd.h, ht.h) AS ab
       FROM pairs p JOIN hd ON CAST(p.drug_key AS VARCHAR) = hd.key JOIN ht ON CAST(p.target_key AS VARCHAR) = ht.key),
pc AS (SELECT *, ab / (na * nb) AS c, least(greatest(ab / (na * nb), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM pp),
dc AS (SELECT *, CASE WHEN c > 1e-6::DOUBLE AND c < 1 - 1e-6::DOUBLE THEN (p - y) / (p * (1 - p)) ELSE 0 END AS dc FROM pc),
dg AS (SELECT seq_id, o.o AS o, sum(CASE WHEN b[o.o + 1] > 0 THEN dc * (a[o.o + 1] / (na * nb) - c / (nb * nb) * b[o.o + 1]) ELSE 0 END) AS v
       FROM dc, range(8) o(o) GROUP BY seq_id, o.o),
dz AS (SELECT dg.seq_id, wt.i AS slice, sum(dg.v * wt.w) AS v FROM dg JOIN wt ON wt.o = dg.o GROUP BY dg.seq_id, wt.i),
n AS (SELECT count(*) AS n FROM pp)
SELECT 'loss' AS name, CAST(0 AS BIGINT) AS idx, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS value FROM pc
UNION ALL
SELECT 'weight', CAST(gap.m AS BIGINT), round(sum(gap.gap * dz.v) / any_value(n.n), 6) FROM gap JOIN dz ON dz.seq_id = gap.seq_id AND dz.slice = gap.slice, n GROUP BY gap.m"""

# Loss of the label-weighted two-layer head and its gradient by both layers, over all labelled vectors.
SQL["fit_multilabel_start"] = f"""WITH {FDIMS},
{wmat('w1', 16, 64, 0)},
{wmat('w2', 10, 16, 3)},
lab AS (SELECT vec_id AS key, CAST(label AS INTEGER) AS y FROM embeddings WHERE label IS NOT NULL),
freq AS (SELECT y, (SELECT count(*) FROM lab)::DOUBLE / count(*) AS weight FROM lab GROUP BY y),
h0 AS (SELECT key, i, CASE WHEN x >= 0 THEN x ELSE 0.2::DOUBLE * x END AS h FROM fdims JOIN lab USING (key)),
h1 AS (SELECT key, w1.o AS i, sum(w1.w * h) AS u FROM h0 JOIN w1 ON w1.i = h0.i GROUP BY key, w1.o),
h1l AS (SELECT key, i, CASE WHEN u >= 0 THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END AS slope, CASE WHEN u >= 0 THEN u ELSE 0.2::DOUBLE * u END AS h FROM h1),
z AS (SELECT key, w2.o AS o, sum(w2.w * h) AS z FROM h1l JOIN w2 ON w2.i = h1l.i GROUP BY key, w2.o),
e AS (SELECT key, o, z, CASE WHEN lab.y = o THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t, coalesce(freq.weight, 0) / 10 AS weight
      FROM z JOIN lab USING (key) LEFT JOIN freq ON freq.y = z.o),
dz AS (SELECT key, o, weight * (1 / (1 + exp(-z)) - t) AS d, weight * (ln(1 + exp(z)) - t * z) AS loss FROM e),
du AS (SELECT dz.key, h1l.i, sum(dz.d * w2.w) * any_value(h1l.slope) AS d FROM dz JOIN w2 ON w2.o = dz.o
       JOIN h1l ON h1l.key = dz.key AND h1l.i = w2.i GROUP BY dz.key, h1l.i),
n AS (SELECT count(*)::DOUBLE AS n FROM lab)
SELECT 'loss' AS name, CAST(0 AS BIGINT) AS idx, round(sum(loss) / any_value(n), 6) AS value FROM dz, n
UNION ALL
SELECT 'w2', CAST(dz.o * 16 + h1l.i AS BIGINT), round(sum(dz.d * h1l.h) / any_value(n), 6) FROM dz JOIN h1l ON h1l.key = dz.key, n GROUP BY dz.o, h1l.i
UNION ALL
SELECT 'w1', CAST(du.i * 64 + h0.i AS BIGINT), round(sum(du.d * h0.h) / any_value(n), 6) FROM du JOIN h0 ON h0.key = du.key, n GROUP BY du.i, h0.i"""
