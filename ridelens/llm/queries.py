"""The training-data operators as registered queries over the driver's tables.

Each query applies one operator, with production parameters, to its whole
table and returns the full result.
"""

from ridelens.llm import oracle
from ridelens.llm.chain_dedup import passage_report
from ridelens.llm.chat_rotation import rotation_report
from ridelens.llm.curriculum_mix import mix_positions
from ridelens.llm.lang_crf import language_report
from ridelens.llm.lanczos_whiten import whitening_report
from ridelens.llm.line_chunks import line_report
from ridelens.llm.merkle_manifest import manifest_report
from ridelens.llm.pca_tiles import near_embeddings
from ridelens.llm.qgram_decontam import leak_report
from ridelens.llm.risk_quality import quality_report
from ridelens.llm.secret_entropy import secret_report
from ridelens.llm.simhash_gray import near_duplicates
from ridelens.llm.toxic_ssk import toxic_report


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_rotation(spark, sf_dir):
    """Every conversation as seen by each of its participants."""
    return rotation_report(table(spark, sf_dir, "conversations"))


def op2_simhash_gray(spark, sf_dir):
    """Fingerprint and near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_chunks(spark, sf_dir):
    """What every document loses to globally repeated chunks of lines."""
    return line_report(table(spark, sf_dir, "documents"))


def op4_lang_crf(spark, sf_dir):
    """Language of every document by a conditional random field over its words."""
    return language_report(table(spark, sf_dir, "documents"))


def op5_secret_entropy(spark, sf_dir):
    """Secrets of every document: pattern spans and high-entropy spans."""
    return secret_report(table(spark, sf_dir, "documents"))


def op6_curriculum_mix(spark, sf_dir):
    """Source targets and the words taken of every document."""
    return mix_positions(table(spark, sf_dir, "documents"))


def op7_risk_quality(spark, sf_dir):
    """Quality measures of every document and the risk-controlled verdict."""
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxic_ssk(spark, sf_dir):
    """Toxicity score of every document by a string-kernel SVM."""
    return toxic_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_qgram_decontam(spark, sf_dir):
    """Benchmark items that every document leaks, within the edit budget."""
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_chain_dedup(spark, sf_dir):
    """Fuzzy passages that every document shares with others."""
    return passage_report(table(spark, sf_dir, "documents"))


def op11_pca_tiles(spark, sf_dir):
    """Links and component of every embedding, by tiled comparison in PCA order."""
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark, sf_dir):
    """Leaf, proof and tamper check of every document under the dataset's Merkle root."""
    return manifest_report(table(spark, sf_dir, "documents"))


def op13_lanczos_whiten(spark, sf_dir):
    """Every embedding in the whitened principal components of the table."""
    return whitening_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_chat_rotation": op1_chat_rotation,
    "op2_simhash_gray": op2_simhash_gray,
    "op3_line_chunks": op3_line_chunks,
    "op4_lang_crf": op4_lang_crf,
    "op5_secret_entropy": op5_secret_entropy,
    "op6_curriculum_mix": op6_curriculum_mix,
    "op7_risk_quality": op7_risk_quality,
    "op8_toxic_ssk": op8_toxic_ssk,
    "op9_qgram_decontam": op9_qgram_decontam,
    "op10_chain_dedup": op10_chain_dedup,
    "op11_pca_tiles": op11_pca_tiles,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_lanczos_whiten": op13_lanczos_whiten,
}

ORACLE = {
    "op1_chat_rotation": oracle.rotation_sql(),
    "op3_line_chunks": oracle.lines_sql(),
    "op5_secret_entropy": oracle.secrets_sql(),
    "op6_curriculum_mix": oracle.mix_sql(),
    "op11_pca_tiles": oracle.embeddings_sql(),
    "op12_merkle_manifest": oracle.manifest_sql(),
}
