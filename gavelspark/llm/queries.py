"""The queries of the training-data operators, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data, span_digest

    return span_digest(find_personal_data(_table(spark, sf_dir, "documents")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), [1.0] * 24)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contained_items

    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_texts

    return pack_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_report

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_report(_table(spark, sf_dir, "documents")).select(*columns)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import rank_documents

    return rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_output import token_digest

    return token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"))


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op6 under all three limits, on instruction data."""
    import public_tokenizers

    from .packing import Limits, conversation_examples, pack_examples

    examples = conversation_examples(_table(spark, sf_dir, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))
    return pack_examples(examples, "conv_id", "tokens", "loss", Limits(tokens=2048, segments=16, loss=1536))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_pii": op2_pii,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sharding": op4_sharding,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_license_scan": op9_license_scan,
    "op10_line_dedup": op10_line_dedup,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_output": op12_token_output,
    "op13_merkle_manifest": op13_merkle_manifest,
    "instruction_packing": instruction_packing,
}

def _ranked_sql(k: int = 50) -> str:
    """Every document against every item, term by term."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
c AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM c),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({terms}) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
      FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term),
x AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
             sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN c USING (r), s GROUP BY item_id, r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {k}"""


def _merkle_sql(levels: int = 8, tops: int = 4) -> str:
    """The tree level by level: for up to 8**levels rows of a language and 8**tops languages."""
    crc_byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')]), lambda c, b: {crc_byte}), 4294967295)"
    fields = ["doc_id", "source", "lang", "n_chars"]

    def hashed(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in [*(f"{f}::VARCHAR" for f in fields), text]) + ")"

    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, {hashed('text')} AS leaf, {hashed(f'CASE WHEN ({crc}) % 3 = 0 THEN {small} ELSE text END')} AS now FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves)",
        "rows0 AS (SELECT doc_id, tree, leaf, i, now AS folded, '' AS proof FROM a0)",
        "nodes0 AS (SELECT tree, i, n, leaf AS h FROM a0)",
    ]

    def climb(rows: str, nodes: str, count: int, extra: str) -> None:
        for k in range(count):
            parts.append(f"{nodes}runs{k} AS (SELECT tree, i // 8 AS i, any_value(n) AS n, list(h ORDER BY i) AS hs FROM {nodes}{k} GROUP BY tree, i // 8)")
            parts.append(f"{nodes}{k + 1} AS (SELECT tree, i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {nodes}runs{k})")
            slot = f"(r.i // {8**k} % 8)"
            parts.append(
                f"{rows}{k + 1} AS (SELECT r.doc_id, r.tree, r.leaf, {extra} r.i,"
                f" CASE WHEN s.n = 1 THEN folded ELSE sha256(array_to_string(list_concat(hs[1:{slot}], [folded], hs[{slot} + 2:]), '')) END AS folded,"
                f" CASE WHEN s.n = 1 THEN proof ELSE proof || array_to_string(list_concat(hs[1:{slot}], hs[{slot} + 2:]), '') END AS proof"
                f" FROM {rows}{k} r JOIN {nodes}runs{k} s ON r.tree = s.tree AND s.i = r.i // {8 ** (k + 1)})"
            )

    climb("rows", "nodes", levels, "")
    parts.append(f"langs AS (SELECT tree AS lang, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes{levels})")
    parts.append("topnodes0 AS (SELECT '' AS tree, i, n, h FROM langs)")
    parts.append(f"toprows0 AS (SELECT doc_id, '' AS tree, leaf, l.h AS subroot, l.i AS i, folded, proof FROM rows{levels} r JOIN langs l ON r.tree = l.lang)")
    climb("toprows", "topnodes", tops, "subroot,")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified FROM toprows{tops} r, topnodes{tops} t"""


#: For the operators that SQL can express; tests/llm has brute-force versions of the others.
ORACLES: dict[str, str] = {"op11_ranked_search": _ranked_sql(), "op13_merkle_manifest": _merkle_sql()}
