import json
import random

from helpers import day

from tidemark.operators.modeling import ModelSizes
from tidemark.operators.scoring import Lexicon, word_chunks
from tidemark.plans.stages import STAGES, Study, run, run_all
from tidemark.sources.facts import CONCEPT_TAGS

TICKERS = ("AA", "BB", "CC")
HEADINGS = ("Item 2. Management's discussion and analysis of financial condition and results of operations", "Item 4. Controls and procedures")


def write_inputs(spark, root):
    random.seed(6)
    ids = {str(i): {"ticker": t, "cik_str": 100 + i} for i, t in enumerate([*TICKERS, "ZZ"])}
    (root / "input/facts").mkdir(parents=True)
    (root / "input/tickers.json").write_text(json.dumps(ids))
    for i in range(len(TICKERS)):
        tags = {
            names[-1]: {"units": {"USD": [
                {"form": "10-Q", "filed": str(day(90 * q + 30)), "end": str(day(90 * q)), "fp": f"Q{q % 4 + 1}", "fy": 2020, "val": random.randrange(1, 1000)}
                for q in range(5)
            ]}}
            for names in CONCEPT_TAGS.values()
        }
        (root / f"input/facts/CIK{100 + i:010d}.json").write_text(json.dumps({"facts": {"us-gaap": tags}}))
    rows, filings = [], []
    for n in range(400):
        rows.append((str(day(n)), *[random.uniform(10, 20) for _ in TICKERS], *[float(random.randrange(100, 200)) for _ in TICKERS]))
    columns = ["Date string", *[f"`Adj Close|{t}` double" for t in TICKERS], *[f"`Volume|{t}` double" for t in TICKERS]]
    spark.createDataFrame(rows, ", ".join(columns)).write.parquet(str(root / "input/prices"))
    for t in TICKERS:
        for q in range(5):
            body = " ".join(random.choices(["good", "bad", "fine", "words"], k=200))
            filings.append((t, "1", t, "10-Q", str(day(90 * q + 31)), str(day(90 * q)), f"{t}-{q}", f"{HEADINGS[0]} {body} {HEADINGS[1]}", None))
    spark.createDataFrame(
        filings, "ticker string, cik string, company_name string, form_type string, filing_date string, period_end string, accession_number string, plain string, markdown string"
    ).write.parquet(str(root / "input/filings"))


def test_study(spark, tmp_path):
    write_inputs(spark, tmp_path)
    study = Study(
        spark, str(tmp_path), tickers=(*TICKERS, "YY"), scorer=Lexicon(("good",), ("bad",)), chunker=word_chunks(50),
        sizes=ModelSizes(20, 3, 3, 2, 2),
    )
    run_all(study)
    assert {r.ticker for r in study.read("reports/unmatched_tickers").collect()} == {"YY"}
    assert {r.ticker for r in study.read("reports/absent_tickers").collect()} == {"YY"}
    assert study.read("reports/missing_concepts").count() == 0
    assert study.read("fundamentals").count() == 15
    assert study.read("prices").count() == 1200 and study.read("prices").where("label is null").count() == 15
    panel = study.read("statement_panel")
    assert panel.count() == 3 * (400 - 30 - 5) and panel.where("filing_date > date").count() == 0
    assert study.read("filing_sentiment").count() == 15 and study.read("section_sentiment").where("mda_found = 1").count() == 15
    sections = study.read("section_panel")
    assert sections.count() == panel.count() and sections.where("sent_filing_date > date").count() == 0
    for result, setups in (("baseline", 1), ("market", 3), ("text_full", 2), ("text_full_mda", 3)):
        metrics = spark.read.json(study.path(f"results/{result}/metrics"))
        assert metrics.count() == setups * 3 * 10
        predictions = study.read(f"results/{result}/predictions")
        keys = predictions.select("ticker", "date", "feature_setup")
        assert keys.count() == keys.distinct().count() > 0
        assert predictions.select("feature_setup").distinct().count() == setups
    for stage in ("filing_index", "filing_sentiment", "section_sentiment"):
        before = study.read(stage).count()
        run(study, stage)
        assert study.read(stage).count() == before
    assert list(STAGES)[0] == "raw_facts"
