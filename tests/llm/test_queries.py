"""The registered operator queries: complete, and equal to their DuckDB texts."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from ridelens.llm.queries import ORACLE, QUERIES
from ridelens.plans.registry import QUERIES as RELATIONAL
from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check_oracle import compare, duck  # noqa: E402


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_matches_duckdb(spark, key):
    assert compare(spark, duck(SF_SMALL), key, QUERIES[key], ORACLE[key], SF_SMALL)


COLUMNS = {
    "op2_simhash_gray": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4_lang_crf": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_secret_entropy": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint",
                           "base_sha256": "string", "spans": "string"},
    "op6_curriculum_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double",
                           "taken": "bigint"},
    "op7_risk_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint",
                         "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean",
                         "kept": "boolean"},
    "op12_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string",
                             "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
    "op8_toxic_ssk": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


@pytest.mark.parametrize("key", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, key):
    found = QUERIES[key](spark, SF_SMALL)
    types = dict(found.dtypes)
    assert COLUMNS[key].items() <= types.items()
    assert found.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_entry_works_without_the_operators(tmp_path):
    """In a copy without the operators' folders the other queries are still registered."""
    import shutil
    shutil.copytree(f"{ROOT}/ridelens", tmp_path / "ridelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
                          cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(RELATIONAL))] * 2, said.stderr
