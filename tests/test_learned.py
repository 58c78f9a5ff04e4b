import pandas as pd
from pyspark.ml.classification import NaiveBayes

from tamiz.operators import classify
from tamiz.queries import learned


def test_selection_reads_whole_texts_in_all_folds(spark, tmp_path, monkeypatch):
    # Titles say nothing, and some are missing: only the bodies tell the subjects apart.
    words = {"economia": "inflación salario banco", "deporte": "gol partido equipo"}
    rows = [(i, None if i % 7 == 0 else "Noticia del día", f"{words[x]} {i}", x) for i, x in enumerate(["economia", "deporte"] * 20)]
    pd.DataFrame([r[:3] for r in rows], columns=["pos", "titulo", "cuerpo"]).to_parquet(tmp_path / "noticias.parquet")
    pd.DataFrame([(r[0], r[3]) for r in rows], columns=["pos", "materia"]).to_parquet(tmp_path / "etiquetas.parquet")
    monkeypatch.setattr(classify, "candidates", lambda seed=42: {"NaiveBayes": NaiveBayes(smoothing=0.1)})
    asked = []
    select = classify.select_model
    monkeypatch.setattr(classify, "select_model", lambda df, *a, **k: asked.append(df.count()) or select(df, *a, **k))
    (row,) = learned.model_selection(spark, str(tmp_path)).collect()
    assert (row.modelo, row.media, row.pliegues, asked) == ("NaiveBayes", 1.0, 5, [40])
