"""Workers that can't import the package: kernels and what they use travel by value."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run_apart(body: str, tmp_path) -> str:
    """Runs ``body`` in a session whose driver alone has the package on its path."""
    script = tmp_path / "driver.py"
    script.write_text(
        textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession, functions as F
        spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
        def there(batches):
            import importlib.util, pyarrow as pa
            for b in batches:
                yield pa.RecordBatch.from_pydict({{"n": pa.array([int(importlib.util.find_spec("siglume") is not None)])}})
        assert not any(r.n for r in spark.range(2).mapInArrow(there, "n long").collect()), "the workers have the package"
        """)
        + textwrap.dedent(body)
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-3000:]
    return got.stdout


def test_signal_kernels(tmp_path):
    out = run_apart(
        """
        from siglume.operators import onsets, probe, sequential
        from siglume.plans.registry import QUERIES
        from siglume.sources.views import sig_events
        sf = "/root/testdata/sf0.001"
        sig = sig_events(spark, sf)
        print(sequential.limiter(sig, "user_id", 0.6, 3, 0.8).count(), onsets.onsets(sig, "user_id", scale=1.5).count() > 0, QUERIES["probe_reports"](spark, sf).count())
        """,
        tmp_path,
    )
    assert out.split() == ["1000", "True", "15"]
