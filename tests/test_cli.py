import io
import json

import pytest
from fixture_flows import SCHEMA, records

from flowloom import cli
from flowloom.sources import store


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli"))
    df = spark.createDataFrame(records(), SCHEMA)
    store.write_store(df, f"{path}/store", distinct_addresses=1000)
    df.coalesce(1).write.parquet(f"{path}/plain")
    return path


def run(spark, *argv):
    out = io.StringIO()
    cli.run(spark, cli.parser().parse_args([*argv, "--progress-bar-type=none"]), out)
    return out.getvalue().splitlines()


def test_statistic(spark, made):
    for where in ("store", "plain"):
        got = run(spark, "-s", "proto", "--output-fields=flows,packets", "--output-format", "csv", f"{made}/{where}")
        assert got == ["proto,flows,packets", "17,1302,1322", "6,238,114719", "1,4,4"]


def test_later_options_win(spark, made):
    assert cli.query_of([("limit", "3"), ("statistic", "srcip")]).top == 10
    assert cli.query_of([("statistic", "srcip"), ("limit", "3")]).top == 3
    got = run(spark, "-s", "srcip", "-l", "2", "-o", "bytes#asc", "--output-format=csv", "--output-fields=", "--output-addr-conv=str", "-f", "proto TCP", f"{made}/plain")
    assert got == ["srcip,bytes", "192.168.1.1,123", "fd69:abdc:93bc:d96c::1,666"]


def test_items(spark, made):
    got = run(spark, "-f", "port 23", "-l", "1", "--output-items=p,m,r", "--output-format=csv", f"{made}/store")
    blank = [i for i, x in enumerate(got) if not x]
    assert len(blank) == 2 and got[blank[0] + 1].startswith("flows,packets") and got[blank[0] + 2].startswith("1119,")
    assert got[blank[1] + 1] == "field,total,TCP,UDP,ICMP,other" and got[blank[1] + 2] == "flows,1544,238,1302,4,0"
    assert run(spark, "--output-items=metadata-summary", f"{made}/store")[0] == "metadata summary:"
    assert "processed records summary:" in run(spark, "-l", "1", f"{made}/plain")


def test_time(spark, made):
    whole = run(spark, "-a", "proto", "--output-format=csv", "-T", "2015-06-02#2015-06-03", f"{made}/store")
    assert len(whole) == 4
    assert run(spark, "-a", "proto", "--output-format=csv", "-T", "2015-06-03#2015-06-04", f"{made}/store") == whole[:1]
    point = run(spark, "--output-items=m", "--output-format=csv", "-t", "2015-06-02 05:16", f"{made}/store")
    assert int(point[1].split(",")[1]) < 1544


@pytest.mark.parametrize(
    "argv",
    [["-t", "2015-06-02", "-T", "2015-06-02"], ["--output-items=x"], ["-l", "x"], ["-f", "port"], ["-a", ""], ["--output-ts-conv=x"], ["-T", "2015-06-03#2015-06-02"], ["-o", "bytes#x"]],
)
def test_errors(spark, made, argv):
    with pytest.raises(ValueError):
        run(spark, *argv, f"{made}/plain")
    assert cli.main([*argv, "--progress-bar-type=none", f"{made}/plain"]) == 1


@pytest.mark.parametrize("argv", [["--nosuch"], ["--output-format=x"], ["-v", "9"], ["--num-threads", "x"], []])
def test_bad_options_end_with_status_1(made, argv):
    assert cli.main([*argv, f"{made}/plain"] if argv else []) == 1


def test_a_top_list_and_its_summary_take_one_pass(spark, made):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("once"))
    spark.sparkContext.setJobGroup("once", "")
    got = run(spark, "-s", "proto", "--output-fields=flows", "--output-format=csv", "--output-items=r,p", "-f", "packets > 0", f"{made}/store")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[0] == "proto,flows" and got[-1].startswith("1544,")
    two = run(spark, "-a", "proto", "--output-fields=flows", "--output-format=csv", "--output-items=r,p", "-f", "packets > 0", f"{made}/store")
    assert two[-1].rsplit(",", 2)[0] == got[-1].rsplit(",", 2)[0] and sorted(two[:4]) == sorted(got[:4]) and jobs() >= 1


def test_exact_widths_without_a_limit(spark, made):
    got = run(spark, "-a", "proto", "--output-fields=flows", "--output-no-ellipsize", "--output-items=r", f"{made}/plain")
    assert len(got) == 4 and len({len(x) for x in got}) == 1


def test_progress(spark, tmp_path):
    bar = cli.Progress(spark, "json", str(tmp_path / "p"))
    bar.start()
    spark.range(10).count()
    bar.over.set()
    bar.join()
    assert json.loads((tmp_path / "p").read_text()) == {"total": 100}
    bar = cli.Progress(spark, "perslave", str(tmp_path / "q"))
    bar.show({"total": 40, "stage3": 40})
    assert (tmp_path / "q").read_text() == "reading records: total 40 %, stage3 40 %\n"
