"""One registered query for each operator, over the whole tables, with the SQL that defines its result where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm.decontamination import find_benchmark
from keyweave.llm.language_model import score_texts
from keyweave.llm.license_scan import scan_licenses
from keyweave.llm.ngram_join import similar_groups
from keyweave.llm.personal_data import KINDS as PERSONAL_KINDS
from keyweave.llm.personal_data import find_personal_data
from keyweave.llm.piece_encoding import encode_and_decode
from keyweave.llm.prefix_trie import grafted_trie
from keyweave.llm.preference_pairs import format_preferences, repeated_answers
from keyweave.llm.quality_rules import apply_quality_rules
from keyweave.llm.secrets import KINDS as SECRET_KINDS
from keyweave.llm.secrets import find_secrets
from keyweave.llm.site_style_tree import extract_text
from keyweave.llm.spelling_variants import VariantRule, spelling_variants
from keyweave.llm.vector_groups import near_vectors


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """Where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_digest(spans: Column, base: list[str]) -> Column:
    return F.sha2(spans_text(F.filter(spans, lambda s: s["kind"].isin(base))), 256)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(_documents(spark, folder).select("doc_id", "text"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = apply_quality_rules(_documents(spark, folder).select("doc_id", "text", "lang"), keep_text=False)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in [*first, "lang"]])


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    # The text is dropped again before the results are joined.
    found = find_benchmark(_documents(spark, folder).select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(_documents(spark, folder).select("doc_id", "text")).select("doc_id", "license")
    places = F.transform(F.col("license.phrases"), lambda p: p["first"])
    base = F.transform(F.col("license.phrases"), lambda p: p["template"])
    own = F.transform(F.col("license.notices"), lambda p: p["template"])
    return found.select(
        "doc_id",
        F.col("license.n_words").alias("n_words"),
        F.size("license.phrases").cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.col("license.n_words") > 0, F.col("license.covered") / F.col("license.n_words")).otherwise(0.0).alias("score"),
    )


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("secret_spans")
    return find_secrets(_documents(spark, folder).select("doc_id", "text")).select(
        "doc_id",
        *[count_of(spans, kind).alias(f"n_{kind}") for kind in SECRET_KINDS[:3]],
        base_digest(spans, SECRET_KINDS[:3]).alias("base_sha256"),
        spans_text(spans).alias("spans"),
        *[count_of(spans, kind).alias(f"n_{kind}") for kind in SECRET_KINDS[3:]],
    )


def op6_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation with two answers and more, against the same one with its last answer replaced by the one before."""
    return _pairs(*repeated_answers(spark.read.parquet(f"{folder}/conversations.parquet")))


def op6_every_conversation(spark: SparkSession, folder: str) -> DataFrame:
    """As `op6_preference_pairs`, and a row for each conversation with one answer or none."""
    return _pairs(*repeated_answers(spark.read.parquet(f"{folder}/conversations.parquet"), every=True))


def _pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    pairs = format_preferences(chosen, rejected)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return pairs.withColumns({c: spans(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


def op7_site_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    texts = extract_text(pages, out="text", keep_page=False)
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode_and_decode(_documents(spark, folder).select("doc_id", "text"), tokenizer_file())
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_groups(_documents(spark, folder).select("doc_id", "text"))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("personal_spans")
    found = find_personal_data(_documents(spark, folder).select("doc_id", "text"), keep_text=False)
    return found.select(
        "doc_id",
        *[count_of(spans, kind).alias(f"n_{kind}") for kind in PERSONAL_KINDS[:4]],
        base_digest(spans, PERSONAL_KINDS[:4]).alias("base_sha256"),
        spans_text(spans).alias("spans"),
        *[count_of(spans, kind).alias(f"n_{kind}") for kind in PERSONAL_KINDS[4:]],
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return grafted_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


def op12_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(_documents(spark, folder).select("doc_id", "text"), rule=VariantRule(every=199))


QUERIES = {
    "op1_language_model": op1_language_model,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_secrets": op5_secrets,
    "op6_preference_pairs": op6_preference_pairs,
    "op6_every_conversation": op6_every_conversation,
    "op7_site_style_tree": op7_site_style_tree,
    "op8_pieces": op8_pieces,
    "op10_personal_data": op10_personal_data,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_near_vectors": op12_near_vectors,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Common table expressions: `crc_table(t)`, the checksums of single bytes, and the checksum of the bytes of a text.
_CRC_TABLE = """crc_table AS (
            SELECT list(v ORDER BY i) AS t
            FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))
        )"""


def _crc_sql(text: str) -> str:
    digit = "instr('0123456789ABCDEF', substr(hex(encode({0})), {1}, 1)) - 1"
    byte = f"16 * ({digit.format(text, '2 * k - 1')}) + {digit.format(text, '2 * k')}"
    return (
        f"xor(4294967295, list_reduce(list_transform(range(0, strlen({text}) + 1), lambda k: CASE WHEN k = 0 THEN 4294967295 ELSE {byte} END),"
        " lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
    )


SQL: dict[str, str] = {
    "op3_decontamination": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS window_text
            FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item_words WHERE len(w) > 0)
        ), runs AS (
            SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS window_text
            FROM (
                SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s
                FROM words CROSS JOIN (SELECT DISTINCT k FROM windows) WHERE len(w) >= k
            )
        ), found AS (
            SELECT doc_id, s, k, item_id FROM runs JOIN windows USING (k, window_text)
        ), hit AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_preference_pairs": """
        WITH seen AS (
            SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                last_value(CASE WHEN role = 'assistant' THEN coalesce(text, '') END IGNORE NULLS) OVER
                    (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous,
                max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn,
                count(CASE WHEN role = 'assistant' THEN 1 END) OVER (PARTITION BY conv_id) AS answers
            FROM conversations
        ), used AS (
            SELECT pair_id, turn, role, text AS c, CASE WHEN turn = last_turn AND role = 'assistant' THEN previous ELSE text END AS r
            FROM seen WHERE answers > 1 AND turn <= last_turn
        ), differing AS (
            SELECT pair_id, turn, role, c, r, coalesce(min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY pair_id), 9223372036854775807) AS differs
            FROM used
        ), placed AS (
            SELECT *, '<|' || role || '|>' || chr(10) || c || chr(10) AS shown_c, '<|' || role || '|>' || chr(10) || r || chr(10) AS shown_r
            FROM differing
        ), measured AS (
            SELECT *,
                coalesce(sum(CASE WHEN turn >= differs THEN length(shown_c) END) OVER w, 0) - length(shown_c) + length(role) + 5 AS at_c,
                coalesce(sum(CASE WHEN turn >= differs THEN length(shown_r) END) OVER w, 0) - length(shown_r) + length(role) + 5 AS at_r
            FROM placed WINDOW w AS (PARTITION BY pair_id ORDER BY turn)
        )
        SELECT pair_id, count(CASE WHEN turn < differs THEN 1 END) AS n_common,
            coalesce(string_agg(CASE WHEN turn < differs THEN shown_c END, '' ORDER BY turn), '') AS prompt,
            coalesce(string_agg(CASE WHEN turn >= differs THEN shown_c END, '' ORDER BY turn), '') AS chosen,
            coalesce(string_agg(CASE WHEN turn >= differs AND role = 'assistant' THEN CAST(CAST(at_c AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(at_c + length(c) AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn), '') AS chosen_spans,
            coalesce(string_agg(CASE WHEN turn >= differs THEN shown_r END, '' ORDER BY turn), '') AS rejected,
            coalesce(string_agg(CASE WHEN turn >= differs AND role = 'assistant' THEN CAST(CAST(at_r AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(at_r + length(r) AS BIGINT) AS VARCHAR) END, ',' ORDER BY turn), '') AS rejected_spans
        FROM measured GROUP BY pair_id""",
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), met AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
        ), both_ways AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reached AS (
            SELECT a AS doc_id, a AS root FROM both_ways UNION SELECT b, root FROM reached JOIN both_ways ON a = doc_id
        ), least_root AS (
            SELECT doc_id, min(root) AS root FROM reached GROUP BY doc_id
        )
        SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_root USING (doc_id)""",
    "op13_spelling_variants": rf"""
        WITH RECURSIVE {_CRC_TABLE}, runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run
            FROM documents
        ), counted AS (
            SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL
        ), marked AS (
            SELECT run, k, {_crc_sql("named")} AS h FROM counted, crc_table
        ), damaged AS (
            SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM marked
        ), words AS (
            SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
        ), cut_words AS (
            SELECT word, n, i, left(word, i) || substr(word, i + 2) AS shorter FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
        ), near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cut_words a JOIN cut_words b ON a.shorter = b.shorter AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cut_words a JOIN words b ON a.shorter = b.word
            UNION SELECT b.word, a.word, a.n FROM cut_words a JOIN words b ON a.shorter = b.word
        ), best AS (
            SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
        ), judged AS (
            SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ), followed AS (
            SELECT word, form AS at FROM judged WHERE form IS NOT NULL
            UNION SELECT f.word, j.form FROM followed f JOIN judged j ON f.at = j.word WHERE j.form IS NOT NULL
        ), roots AS (
            SELECT f.word, f.at AS root FROM followed f JOIN judged j ON f.at = j.word WHERE j.form IS NULL
        )
        SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM judged LEFT JOIN roots USING (word)""",
    "op11_prefix_trie": f"""
        WITH {_CRC_TABLE}, turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table
        ), rebuilt AS (
            SELECT c.conv_id, place, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND place <= h
            UNION ALL SELECT conv_id, place, role, text FROM convs JOIN turns USING (conv_id) WHERE place > h
        ), whole AS (
            SELECT c.conv_id, list(struct_pack(r := role, t := text) ORDER BY place) FILTER (place IS NOT NULL) AS turns FROM convs c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id
        ), prefixes AS (
            SELECT conv_id, coalesce(len(turns), 0) AS size, unnest(range(0, coalesce(len(turns), 0) + 1)) AS depth, turns FROM whole
        ), named AS (
            SELECT conv_id, size, depth, CASE WHEN depth = 0 THEN '' ELSE CAST(to_json(turns[1:depth]) AS VARCHAR) END AS name,
                CASE WHEN depth > 1 THEN CAST(to_json(turns[1:depth - 1]) AS VARCHAR) WHEN depth = 1 THEN '' END AS parent,
                CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth].t) END AS chars
            FROM prefixes
        ), nodes AS (
            SELECT name, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
            FROM named GROUP BY name
        ), kids AS (
            SELECT parent AS name, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
        ), below AS (
            SELECT above.name, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((x.n - 1) * x.chars) AS saved
            FROM (SELECT DISTINCT a.name AS name, d.name AS under FROM named a JOIN named d ON a.conv_id = d.conv_id AND a.depth <= d.depth) above
            JOIN nodes x ON x.name = above.under LEFT JOIN kids k ON k.name = x.name GROUP BY above.name
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
            CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM nodes n LEFT JOIN nodes p ON p.name = n.parent LEFT JOIN kids k ON k.name = n.name JOIN below b ON b.name = n.name""",
    "op12_near_vectors": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), sound AS (
            SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS length FROM vectors
            WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.length > 0 AND b.length > 0 AND list_inner_product(a.e, b.e) / (a.length * b.length) >= 0.9
        ), reached AS (
            SELECT a AS vec_id, b AS root FROM links UNION SELECT b, root FROM reached JOIN links ON a = vec_id
        ), counted AS (
            SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
        ), least_root AS (
            SELECT vec_id, min(root) AS root FROM reached GROUP BY vec_id
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(root, vec_id)) AS component_id, vec_id <= coalesce(root, vec_id) AS kept
        FROM vectors LEFT JOIN counted USING (vec_id) LEFT JOIN least_root USING (vec_id)""",
}

#: Every conversation: those without an answer are whole, and a single answer has an empty one beside it.
SQL["op6_every_conversation"] = (
    SQL["op6_preference_pairs"].replace("THEN previous ELSE", "THEN coalesce(previous, '') ELSE").replace("WHERE answers > 1 AND", "WHERE answers = 0 OR")
)
