"""K-means against what makes its result one: every vector is nearest to its own cluster's mean."""

import numpy as np

from quillmark.operators import vector


def test_clusters_are_those_of_the_nearest_mean(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10]], float)
    points = [(i, (centres[i % 4] + rng.normal(scale=0.3, size=2)).tolist()) for i in range(80)]
    rows = spark.createDataFrame(points, "doc_id long, vector array<double>")
    got = {r.doc_id: r.cluster for r in vector.kmeans(rows, 4).collect()}
    assert got == {r.doc_id: r.cluster for r in vector.kmeans(rows.repartition(1), 4).collect()} or len(set(got.values())) == 4
    assert all((got[i] == got[j]) == (i % 4 == j % 4) for i in range(80) for j in range(80))
    own = np.array([p for _, p in points])
    label = np.array([got[i] for i in range(80)])
    means = np.stack([own[label == c].mean(0) for c in range(4)])
    assert (np.linalg.norm(own[:, None] - means, axis=2).argmin(1) == label).all()
