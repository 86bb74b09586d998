"""Workers need Spark's own dependencies only."""

import elsewhere


def test_network_and_forecasts_run_without_the_package_on_executors(tmp_path, sf_dir):
    said = elsewhere.run(tmp_path, f"""
        for name in ("f7_score", "h3_ets", "p1_windows_chunked"):
            print(name, entry.queries()[name](spark, {sf_dir!r}).limit(5).count())
    """)
    assert said.split() == ["f7_score", "5", "h3_ets", "5", "p1_windows_chunked", "5"]
