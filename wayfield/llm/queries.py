"""The queries op1 to op13: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of documents with similarity 0.75 on five-word shingles."""
    from wayfield.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: words inside any occurrence of a benchmark window."""
    from wayfield.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.selectExpr(
        "doc_id", "n_words", "n_hit", "cast(size(item_ids) as long) n_items", "sha2(array_join(item_ids, ','), 256) items_sha256",
        "n_hit > 0 and 20 * n_hit >= n_words contaminated",
    )


@query
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: words that the mix takes of each document."""
    from wayfield.llm.mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "copies * size taken")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality."""
    from wayfield.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.selectExpr("d.doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words", "base_failed", "kept", "quality")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated passages, n_sentences, n_removed, chars_removed, changed."""
    from wayfield.llm.substring import without_repeats

    cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.selectExpr("*", "n_removed > 0 changed")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: read back from archives of all pages."""
    from wayfield.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).drop("archive")


ORACLE["op8_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) body from pages),
  d as (select page_id, octet_length(body) n, sha256(body) digest from p),
  f as (select digest, min(page_id) first from d where n >= 100 group by digest)
select page_id, n payload_bytes, d.digest payload_digest,
  case when first is not null and first <> page_id then 'revisit' else 'response' end record_type,
  case when first <> page_id then first end::double refers_to
from d left join f on d.digest = f.digest and d.n >= 100
"""


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from the windows."""
    from wayfield.llm.chat import read_back, windows

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], turns.schema)
    return read_back(windows(turns.unionByName(extra)))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits: learned from labelled documents that are not held out."""
    from wayfield.llm.store import crc_rest
    from wayfield.llm.toxicity import learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_rest(F.col("doc_id"), 3) == 1
    known = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held)
    lexicon, model = learn(docs, known)
    return score(docs, lexicon, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, field, section, n_bytes, n_tokens, doc_tokens for every field and line of every document."""
    from wayfield.llm.tokens import section_tokens

    return section_tokens(table(spark, sf_dir, "documents"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all documents."""
    from wayfield.llm.ngram import score, train
    from wayfield.llm.store import crc_rest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_rest(F.col("doc_id"), 7) == 2
    return score(docs, train(docs.filter(~held))).withColumn("held_out", held)


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: members, children, leaves, savings and who ends there."""
    from wayfield.llm.trie import prefix_trie, shared_heads, turn_digests

    return prefix_trie(*shared_heads(turn_digests(table(spark, sf_dir, "conversations"))))


ORACLE["op11_conversation_trie"] = """
with recursive t as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() over (partition by conv_id order by turn nulls first) - 1 n from conversations),
  lens as (select c, count(*) len, c - c % 100 base from t group by c),
  bits as (select c::varchar || '' s, c, 0 i, 4294967295::bigint v from lens union all
    select s, c, i + 1, list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end, xor(v, ascii(s[i + 1])::bigint)) from bits where i < length(s)),
  heads as (select l.c, l.base, xor(v, 4294967295::bigint) % 6 h from lens l join bits b on b.c = l.c and b.i = length(b.s)),
  got as (select h.c, h.base, h.h, least(h.h, coalesce(l.len, 0)) g from heads h left join lens l on l.c = h.base),
  turns as (select g.c, t.n, r, x from got g join t on t.c = g.base and t.n < g.h union all select g.c, t.n - g.h + g.g, r, x from got g join t on t.c = g.c and t.n >= g.h),
  paths as (select c, n + 1 d, length(x) size, string_agg(sha256(length(r) || ':' || r || x), '') over (partition by c order by n rows between unbounded preceding and current row) k from turns
    union all select c, 0, 0, '' from lens),
  keyed as (select c, d, size, sha256(k) k, lag(sha256(k)) over (partition by c order by d) p, max(d) over (partition by c) last from paths),
  nodes as (select k, any_value(p) p, any_value(d) d, any_value(size) size, min(c) c, count(*) n,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = last), '')) ends from keyed group by k),
  kids as (select p, count(*) n from nodes where p is not null group by p),
  worth as (select nodes.c, d, (nodes.n - 1) * size saved, (kids.p is null)::bigint leaf from nodes left join kids on kids.p = nodes.k),
  sums as (select q.k, sum(saved)::bigint saved, sum(leaf)::bigint leaves from worth w join keyed q on q.c = w.c and q.d <= w.d group by q.k)
select nodes.c conv_id, nodes.d depth, above.c::double parent_conv_id, nodes.n n_convs, coalesce(kids.n, 0) n_children, leaves n_leaves, saved saved_tokens, nodes.ends ends_sha256
from nodes join sums on sums.k = nodes.k left join kids on kids.p = nodes.k left join nodes above on above.k = nodes.p
"""


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page, with weights learned from all pages that mark an article."""
    from wayfield.llm.html import extract, weights

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, weights(pages))


# what the rule comes to where every page marks its article and its blocks are headings and paragraphs
ORACLE["op12_html_extraction"] = """
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) x from pages),
  b as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '<br>', ' ', 'g'), '</?(h1|p)>', chr(10), 'g'), '<[^>]*>', '', 'g') x from a),
  c as (select page_id, url, list_filter(list_transform(string_split(x, chr(10)), lambda l: trim(regexp_replace(l, ' +', ' ', 'g'))), lambda l: l <> '') w from b),
  d as (select page_id, url, replace(replace(replace(regexp_replace(array_to_string(w, chr(10)), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)) x from c)
select page_id, url, regexp_replace(x, '&amp;?', '&', 'g') "text", length(regexp_replace(x, '&amp;?', '&', 'g')) n_chars from d
"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of all documents."""
    from wayfield.llm.fim import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE["op13_fill_in_middle"] = """
with d as (select doc_id, coalesce(text, '') x, sha256('1:' || doc_id::varchar) s from documents),
  t as (select *, regexp_extract_all(x, '[A-Za-z]+|[^A-Za-z]') w, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(s, i, 8))::bigint) h from d),
  u as (select *, len(w) n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) i, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) j,
    case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or h[3] % 100 >= 90 then 'plain' when h[4] % 100 < 20 then 'spm' else 'psm' end form from t),
  v as (select *, array_to_string(w[1:i], '') p, array_to_string(w[i + 1 : j], '') m, array_to_string(w[j + 1 : n], '') e from u)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end::double prefix_chars, case when form <> 'plain' then length(m) end::double middle_chars,
  sha256(case form when 'plain' then x when 'psm' then '<P>' || p || '<S>' || e || '<M>' || m else '<S>' || e || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(x) restored_sha256
from v
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE["op5_benchmark_decontamination"] = f"""
with items as (select item_id, {_ALNUM} w from benchmark),
  windows as (select distinct item_id, least(13, len(w)) size, array_to_string(w[i : i + 12], ' ') win
    from (select item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) i from items where len(w) > 0)),
  docs as (select doc_id, {_ALNUM} w from documents),
  cuts as (select doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') win
    from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) i from docs, (select distinct size from windows) where len(w) >= size)),
  hits as (select doc_id, i, c.size, item_id from cuts c join windows v on c.win = v.win and c.size = v.size),
  covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + size)) p from hits) group by doc_id),
  named as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hits group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from docs d left join covered c on c.doc_id = d.doc_id left join named n on n.doc_id = d.doc_id
"""

ORACLE["op9_minhash_near_dedup"] = f"""
with recursive docs as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
  shingles as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') s
    from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from docs where len(w) > 0)),
  sizes as (select doc_id, count(*) n from shingles group by doc_id),
  pairs as (select a.doc_id a, b.doc_id b, count(*) k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
  links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
  ways as (select a, b from links union all select b, a from links),
  reach as (select doc_id, doc_id r from sizes union select ways.b, reach.r from reach join ways on ways.a = reach.doc_id),
  least_id as (select doc_id, min(r) c from reach group by doc_id)
select d.doc_id, coalesce(n, 0) n_shingles, coalesce(c, d.doc_id) component_id, d.doc_id = coalesce(c, d.doc_id) kept
from docs d left join sizes z on z.doc_id = d.doc_id left join least_id l on l.doc_id = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries, and the pipeline."""
    import corpus_pipeline

    return dict(QUERIES) | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return dict(ORACLE) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
