"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def register(name: str, oracle: str | None = None):
    def wrap(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLE[name] = oracle
        return build

    return wrap


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.token_files import read_token_files, write_token_files

    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), vocabulary())).drop("file")


@register(
    "op3_warc",
    """
    with p as (select page_id, coalesce(html, '') h from pages),
    d as (select page_id, strlen(h) payload_bytes, sha256(h) payload_digest from p),
    f as (select payload_digest, min(page_id) first from d where payload_bytes >= 100 group by 1)
    select page_id, payload_bytes::bigint payload_bytes, d.payload_digest,
      case when first is not null and first is distinct from page_id then 'revisit' else 'response' end record_type,
      case when first is distinct from page_id then first end refers_to
    from d left join f on d.payload_digest = f.payload_digest and payload_bytes >= 100
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.warc import read_archives, write_archives

    found = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@register(
    "op5_mixing",
    """
    with d as (
      select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint size,
        ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '')), 1, 12))::bigint hash
      from documents),
    b as (select source, hash // 274877906944 bin, sum(size)::bigint words from d group by 1, 2),
    s as (select source, sum(words)::bigint source_size from b group by 1),
    o as (select *, row_number() over (order by source nulls last) n from s),
    w as (select *, case when source_size > 0 then [3.0::double, 1.0::double, 2.0::double][((n - 1) % 3 + 1)::int] else 0.0::double end weight,
        source_size * 2.0::double cap from o),
    r as (select *, case when weight > 0 then cap / weight end ratio from w),
    l as (select *, case when weight > 0 then greatest((sum(source_size) over ())::double * 1.5::double
          - coalesce(sum(cap) over (order by ratio nulls last, n rows between unbounded preceding and 1 preceding), 0.0::double), 0.0::double)
        / sum(weight) over (order by ratio nulls last, n rows between current row and unbounded following) end level from r),
    q as (select *, (select level from l where ratio >= level order by ratio, n limit 1) final from l),
    t as (select source, source_size, case when weight = 0 then 0.0::double when final is null then cap else least(cap, final * weight) end target from q),
    p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint whole from t),
    p2 as (select *, target - whole * source_size rest from p),
    u as (select *, (sum(words) over (partition by source order by bin))::bigint upto from b),
    c as (select p2.source, arg_min(bin, bin) bin, arg_min(upto, bin) upto, arg_min(words, bin) words
      from u join p2 on u.source is not distinct from p2.source where upto > rest group by 1),
    e as (select p2.*, case when rest > 0 then coalesce((bin * 274877906944 + floor((rest - (upto - words)) / words * 274877906944))::bigint, 281474976710656) else 0 end below
      from p2 left join c on p2.source is not distinct from c.source)
    select doc_id, size, source_size, target, (whole + (hash < below)::bigint)::bigint copies, (size * (whole + (hash < below)::bigint))::bigint taken
    from d join e on d.source is not distinct from e.source
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.mixing import mixed_documents

    return mixed_documents(table(spark, sf_dir, "documents"))


@register(
    "op10_url_filters",
    """
    with u as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end rest from pages),
    p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from u),
    r(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    m as (select page_id, arg_max(h || p, length(h || p)) rule, arg_max(verdict, length(h || p)) verdict
      from (select page_id, host, path from p) x(page_id, host, path), r
      where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1)
    select p.page_id, host, path, rule, coalesce(verdict, 'allow') verdict from p left join m on p.page_id = m.page_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES, "page_id", "url")


@register("op6_languages")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.language import fit_languages, predict_languages

    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


@register("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept")


@register("op4_multi_index")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.multi_index import search

    return search(table(spark, sf_dir, "embeddings"), "id % 100 = 0")


@register("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register(
    "op11_importance_resampling",
    """
    with recursive bits as (select i, i c, 0 k from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
    crc as (select list(c order by i) t from bits where k = 8),
    words as (
      select 'd' side, doc_id id, row_number() over () n, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
      union all
      select 'b', item_id, row_number() over (), regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
    grams as (
      select side, n, unnest(list_concat(w, list_concat(
        [w[i] || ' ' || w[i + 1] for i in range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]))) g
      from words where w is not null),
    told as (select side, n, g, count(*) m from grams group by all),
    kinds as (select distinct g from told),
    buckets as (
      select g, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(hex(encode(g)), 2 * i - 1, 2))::bigint for i in range(1, strlen(g) + 1)]),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 bucket
      from kinds, crc),
    joined as (select side, n, bucket, m from told join buckets using (g)),
    sums as (select bucket, sum(m) filter (side = 'd') s, sum(m) filter (side = 'b') t from joined group by 1),
    alls as (select coalesce(sum(s), 0)::double s_all, coalesce(sum(t), 0)::double t_all from sums),
    gain as (select bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::double * (s_all + 10000)) / ((coalesce(s, 0) + 1)::double * (t_all + 10000)))) gain from sums, alls),
    weights as (select n, sum(m)::bigint n_features, sum(m * gain)::bigint weight from joined join gain using (bucket) where side = 'd' group by 1),
    scored as (
      select id doc_id, coalesce(len(w), 0) n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint score
      from words left join weights using (n) where side = 'd'),
    placed as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls first) place, count(*) over (partition by n_words >= 20) many from scored)
    select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * many // 100 then place end::bigint rank from placed
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register(
    "op12_merkle_manifest",
    """
    with recursive bits as (select i, i c, 0 k from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
    crc as (select list(c order by i) t from bits where k = 8),
    d as (
      select doc_id, lang, case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end
        || case when source is null then '-' else strlen(source) || ':' || source end || case when lang is null then '-' else strlen(lang) || ':' || lang end
        || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end head,
        text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') lowered,
        xor(list_reduce(list_prepend(4294967295, [('0x' || substr(hex(encode(doc_id::varchar)), 2 * i - 1, 2))::bigint for i in range(1, strlen(doc_id::varchar) + 1)]),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 hit
      from documents, crc),
    l as (
      select doc_id, coalesce('v' || lang, '-') tree, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) leaf,
        case when hit then sha256(head || case when lowered is null then '-' else strlen(lowered) || ':' || lowered end) else leaf end used from d),
    p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 p, count(*) over (partition by tree) n from l),
    nodes as (
      select tree, 0 lv, p, leaf h, n from p
      union all
      select tree, lv + 1, p // 8, sha256(string_agg(h, '' order by p)), any_value((n + 7) // 8) from nodes where n > 1 group by tree, lv, p // 8),
    tops as (select tree, lv height, h subroot, row_number() over (order by tree) - 1 k, count(*) over () trees from nodes where n = 1),
    upper as (
      select 0 lv, k p, subroot h, trees n from tops
      union all
      select lv + 1, p // 8, sha256(string_agg(h, '' order by p)), any_value((n + 7) // 8) from upper where n > 1 group by lv, p // 8),
    all_nodes as (select tree, lv, p, h, n from nodes where n > 1 union all select t.tree, t.height + u.lv, u.p, u.h, u.n from upper u, tops t where u.n > 1),
    paths as (
      select row_number() over () r, p.doc_id, p.leaf, p.used, p.p, t.* from p join tops t using (tree)),
    steps as (
      select r, tree, lv, case when lv < height then p >> (3 * lv)::int else k >> (3 * greatest(lv - height, 0))::int end q
      from paths, range(0, 20) x(lv)),
    sides as (
      select r, s.lv, coalesce(string_agg(h, '' order by a.p) filter (a.p < q), '') lefts, coalesce(string_agg(h, '' order by a.p) filter (a.p > q), '') rights
      from steps s join all_nodes a on s.tree = a.tree and s.lv = a.lv and a.p // 8 = q // 8 group by r, s.lv),
    proofs as (select r, string_agg(lefts || rights, '' order by lv) proof, max(lv) + 1 steps from sides group by r),
    fold as (
      select r, 0 lv, used h from paths
      union all
      select f.r, f.lv + 1, sha256(lefts || h || rights) from fold f join sides s on f.r = s.r and f.lv = s.lv)
    select doc_id, leaf, subroot, u.h root, sha256(coalesce(proof, '')) proof_sha256, f.h folded_root, f.h = u.h verified
    from paths left join proofs using (r) join fold f on paths.r = f.r and f.lv = coalesce(steps, 0) cross join (select h from upper where n = 1) u
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.merkle import merkle_manifest

    return merkle_manifest(table(spark, sf_dir, "documents"), with_proof=False)


@register("op13_linear_grouping")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstone.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)
