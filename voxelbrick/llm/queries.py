"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, minhash, mixing, negatives, pii, pq, quality, rules, toxicity, variants, warc
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and counts of personal data in every document. Null and empty texts have none; every row gives a row, repeated or without doc_id too."""
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, formatted and read back. Null texts and roles are empty; null conv_id is a conversation; equal turns go by role and text."""
    extra = spark.createDataFrame([(-7, 0, "user", _SAID), (-7, 1, "assistant", _SAID)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.chat_digest(chat.format_trees(chat.chain(rows)))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of equal labels. Vectors that can't be compared, and rows without vec_id, link with nothing."""
    return pq.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back. Null html is an empty payload; a page without page_id has a record, repeated rows have one each."""
    return warc.warc_digest(table(spark, sf_dir, "pages"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text. Null is empty; every row gives a row."""
    return bpe.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of each document. Null and empty texts have size 0; a null source is a source; repeated rows share copies."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document: a row for each document and item found. Null and empty texts or items match nothing."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates, two-word shingles. Texts without words link with nothing; rows without doc_id aren't kept; rows of one doc_id are one document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text; empty texts get one too. Labels without a value don't count."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every whole text; texts without words score 0. Labels without a value don't count."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.tag(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("toxic_spans")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their nearest more frequent spelling. Null texts have no words; repeated rows count as often as they are there."""
    return variants.variants(variants.counted(table(spark, sf_dir, "documents")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and risk-controlled rules, languages as strata. Null and empty texts have no words and fail; every row gives a row."""
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector. Rows without id, label or a whole vector take no part; of rows with one vec_id the first by label and vector counts."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    rows = negatives.quantised(table(spark, sf_dir, "embeddings"), relabel=F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.hard_negatives(rows, vec_id % 50 == 0)


def queries() -> dict:
    both = (op1_pii, op2_decontamination, op3_chat, op4_near_vectors, op5_warc, op6_tokens, op7_mixing, op8_near_duplicates, op9_quality, op10_toxicity, op11_spelling_variants, op12_quality_rules, op13_hard_negatives)
    return {f.__name__: f for f in both}


_SAID = "</s>[INST] ok [/INST]"
_BY = "order by turn nulls first, role nulls first, text nulls first"
_ROLE = "coalesce(role, '')"
for _a, _b in chat.ROLE_ESCAPES:
    _ROLE = f"replace({_ROLE}, '{_a}', '{_b}')"
#: The smallest node reachable over links (a, b) for each of nodes (id).
_REACHED = "both_ways as (select a, b from links union all select b, a from links), reached(id, root) as (select id, id from nodes union select e.b, r.root from reached r join both_ways e on e.a = r.id), classes as (select id, min(root) component_id from reached group by id)"

SQL = {
    "op3_chat": rf"""
        with c as (select conv_id, turn, role, text from conversations union all from (values (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}'))),
        t as (select *, coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10) said, coalesce(text, '') learnt,
              length('<|turn:' || {_ROLE} || '|>' || chr(10)) + length(regexp_replace(coalesce(text, ''), '<(\\*)[|]', '<\1\\|', 'g')) + {len(chat.END)} whole from c),
        g as (select conv_id, count(*) n_turns, string_agg(said, '' {_BY}) said, coalesce(string_agg(learnt, '' {_BY}) filter (role = 'assistant'), '') learnt, sum(whole) whole from t group by conv_id)
        select conv_id, n_turns, sha256(said) turns_sha256, length(learnt)::bigint loss_chars, sha256(learnt) loss_sha256, whole::bigint formatted_chars from g""",
    "op4_near_vectors": f"""
        with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null),
        good as (select * from v where list_bool_and([x is not null and isfinite(x) for x in e]) and list_bool_or([x <> 0 for x in e])),
        links as (select a.vec_id a, b.vec_id b from good a join good b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
        nodes as (select vec_id id from embeddings), {_REACHED}
        select id vec_id, (select count(*) from both_ways where a = id) n_links, component_id, id = component_id kept from classes""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') html, octet_length(encode(coalesce(html, ''))) n from pages),
        f as (select page_id, n, sha1(encode(html)) d, max(page_id) over (partition by html) last from p)
        select page_id, n::bigint payload_bytes, d payload_digest,
               case when n >= 1000 and last <> page_id then 'revisit' else 'response' end record_type,
               case when n >= 1000 and last <> page_id then last end refers_to, null::varchar problem
        from f""",
    "op8_near_duplicates": rf"""
        with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
        s as (select doc_id, unnest(list_distinct(case when len(w) < 2 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end)) g from w),
        n as (select doc_id, count(*) n from s group by doc_id),
        pairs as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
        nodes as (select doc_id id from documents), {_REACHED}
        select id doc_id, coalesce(n, 0) n_shingles, component_id, id = component_id kept from classes left join n on n.doc_id = id""",
    "op12_quality_rules": rf"""
        with d as (select row_number() over () id, doc_id, coalesce(lang, '') s, coalesce(text, '') x from documents),
        w as (select *, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda q: q <> '') w, list_filter(string_split(x, chr(10)), lambda q: regexp_matches(q, '[^\x20\x09-\x0D]')) l from d),
        win as (select id, unnest(range(1, len(w) - 1)) i, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) g from w),
        twice as (select id, i from win qualify count(*) over (partition by id, g) > 1),
        rep as (select id, count(distinct i + k) n from twice, (select unnest([0, 1, 2]) k) group by id),
        b as (select w.id, doc_id, s, len(w)::bigint n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
              (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words, len(l) n_lines from w left join rep using (id)),
        f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
              [least({rules.TOP}, coalesce(100 * n_symbols // nullif(n_words, 0), 0)), least({rules.TOP}, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0)), least({rules.TOP}, coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0)),
               least({rules.TOP}, coalesce(20 * word_chars // nullif(n_words, 0), 0)), {rules.TOP} - least({rules.TOP}, coalesce(20 * word_chars // nullif(n_words, 0), 0))] g from b),
        lab as (select doc_id, max(quality) >= 1 good from labels where quality is not null and doc_id is not null group by doc_id),
        known as (select f.s, good, g, substr(md5(f.doc_id::varchar), 1, 1) < '8' tuning from f join lab using (doc_id) where not base_failed),
        each as (select s, good, unnest(range(0, 5)) r, unnest(g) v from known where tuning),
        c as (select s, r, v, count(*) filter (good) a, count(*) filter (not good) z from each group by all),
        sums as (select s, r, v, sum(a) over (partition by s, r) na, sum(z) over (partition by s, r) nz, coalesce(sum(a) over o, 0) a, coalesce(sum(z) over o, 0) z from c window o as (partition by s, r order by v desc rows between unbounded preceding and 1 preceding)),
        steps as (select *, row_number() over (partition by s, r, j order by v) k from sums, (select unnest(range(0, {rules.LEVELS + 1})) j) where a <= floor(na * j * ({rules.RISK / rules.LEVELS}::double))),
        cuts as (select s, j, list(case when z > 0 and z * na >= {rules.LIFT} * a * nz then v end order by r) cut from steps where k = 1 group by s, j),
        hit as (select known.s, tuning, good, j, list_bool_or([coalesce(g[i] > cut[i], false) for i in range(1, 6)]) h from known join cuts on known.s = cuts.s),
        shares as (select s, j, count(*) filter (tuning and good and h) tg, count(*) filter (tuning and good) tga, count(*) filter (tuning and not good and h) tb, count(*) filter (tuning and not good) tba,
                   count(*) filter (not tuning and good and h) k, count(*) filter (not tuning and good) n from hit group by all),
        tail as (select *, case when n = 0 or k > n * {rules.RISK}::double then 1 else list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rules.RISK}::double) + (n - i) * ln(1 - {rules.RISK}::double)) for i in range(0, k + 1)]) end p from shares),
        pick as (select * from tail where p <= {rules.ERROR}::double / (select count(distinct s) from known)
                 qualify row_number() over (partition by s order by coalesce(tb / nullif(tba, 0), 0) - coalesce(tg / nullif(tga, 0), 0) desc, j) = 1),
        verdict as (select f.*, pick.j, list_position([coalesce(g[i] > cut[i], false) for i in range(1, 6)], true) h from f left join pick on pick.s = f.s left join cuts on cuts.s = f.s and cuts.j = pick.j)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(h, 0) = 0 kept,
               case when base_failed then 'base' when coalesce(h, 0) > 0 then {list(rules.RULES)!r}[h] end "rule", j::integer "level" from verdict""",
    "op13_hard_negatives": """
        with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l, [floor(256 * x::double) for x in embedding] q from embeddings
                   where vec_id is not null and label is not null and embedding is not null and list_bool_and([x is not null and isfinite(x) for x in embedding])),
        s as (select a.vec_id a, b.vec_id b, a.l = b.l same, list_inner_product(a.q, b.q)::bigint s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
        p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
        n as (select p.a, p.b, p.s ps, s.b nb, s.s ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) k
              from p join s on s.a = p.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
        select a anchor_id, b positive_id, k::integer rank, nb negative_id, ps positive_score, ns negative_score from n where k <= 3""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
