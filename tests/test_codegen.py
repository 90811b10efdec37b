"""Generated Python runs under its generated tests; other languages name what they declare."""

import os
import re
import subprocess
import sys

import pytest
from plumbline.operators import codegen
from pyspark.sql import functions as F

FUNCTIONS = [("PAY-ROLL", 1, "COMPUTE-PAY"), ("PAY-ROLL", 2, "class"), ("PAY-ROLL", 3, "9-lives"), ("PAY-ROLL", 4, "compute_pay"), ("Brand#12", 1, 'say "hi"'), ("Shop::Cart", 1, "return"), ("empty", 1, None), ("9x", 1, "a*/b")]
FIELDS = [("PAY-ROLL", "EMP-REC", 1, "EMP-NAME", "string", 30), ("PAY-ROLL", "EMP-REC", 2, "PAY", "decimal", 9), ("PAY-ROLL", "EMP-REC", 3, "emp_name", "string", 1), ("PAY-ROLL", "EMP-REC", 4, "class", "array<integer>", 12), ("PAY-ROLL", "EMP-REC", 5, "SUB-REC", "struct", 0), ("PAY-ROLL", "SUB-REC", 1, "9", "unknown", 0)]


@pytest.fixture(scope="module")
def functions(spark):
    return spark.createDataFrame(FUNCTIONS, "module string, ord long, function string")


@pytest.fixture(scope="module")
def fields(spark):
    return spark.createDataFrame(FIELDS, "module string, type string, ord long, field string, kind string, size int")


def test_python_runs(spark, functions, fields, tmp_path):
    files = codegen.all_files(codegen.scaffold(spark, "python"), codegen.generate(functions, "python"), codegen.generate_tests(functions, "python"), codegen.generate_models(fields, "python"))
    for r in files.collect():
        path = tmp_path / r.path
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(r.content)
    (tmp_path / "generated/models/__init__.py").write_text("")
    (tmp_path / "tests/test_models.py").write_text("from generated.models.emp_rec import EmpRec\n\n\ndef test_fields():\n    assert list(EmpRec.__dataclass_fields__) == ['emp_name', 'pay', 'class_', 'sub_rec']\n")
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
    assert run.returncode == 0 and "7 passed" in run.stdout, run.stdout + run.stderr


@pytest.mark.parametrize("language", list(codegen.LANGUAGES))
def test_names_are_declared(spark, functions, language):
    code = "".join(r.content for r in codegen.all_files(codegen.generate(functions, language), codegen.scaffold(spark, language)).collect())
    tests = "".join(r.content for r in codegen.generate_tests(functions, language).collect())
    declared = set(re.findall(r"(?:class|type) (\w+)", code))
    assert set(re.findall(r"\b(\w+Service)\b", code + tests)) <= declared and not re.search(r"[{](Module|Pascal|raw|camel|snake)[}]", code + tests)
    if language == "go":
        methods = re.findall(r"func \(s \*(\w+)\) (\w+)\(", code)
        assert len(methods) == len(set(methods)) == 6 and "var ErrUnsupported" in code and len(set(re.findall(r"func (Test\w+)", tests))) == 6


@pytest.mark.parametrize("language", list(codegen.MODELS))
def test_models(fields, language):
    made = {r.type: r.content for r in codegen.generate_models(fields, language).collect()}
    assert set(made) == {"EMP-REC", "SUB-REC"} and "EmpRec" in made["EMP-REC"] and "SubRec" in made["EMP-REC"]
    assert made["EMP-REC"].count("tring" if language != "python" else ": str") == 1


def test_no_rows(spark, functions):
    assert codegen.generate(functions.filter(F.lit(False)), "go").count() == 0
