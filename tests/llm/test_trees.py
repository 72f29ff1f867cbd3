"""Fitted trees as constants of numbers."""

import random
from types import SimpleNamespace

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from orderlens.llm import boosting, pii


def leaf(value):
    return SimpleNamespace(prediction=lambda: value, getClass=lambda: SimpleNamespace(getSimpleName=lambda: "LeafNode"))


def node(feature, threshold, left, right):
    split = SimpleNamespace(featureIndex=lambda: feature, threshold=lambda: threshold)
    return SimpleNamespace(split=lambda: split, leftChild=lambda: left, rightChild=lambda: right,
                           getClass=lambda: SimpleNamespace(getSimpleName=lambda: "InternalNode"))


def model(trees, depth):
    made = object.__new__(pii.Model)
    made.depth, made.trees = depth, [(weight, pii._flat(root, depth)) for weight, root in trees]
    return made


def test_flat_trees_score_like_the_trees(spark):
    trees = [(1.0, node(0, 0.5, leaf(-0.25), node(1, -1e-5, leaf(0.1), leaf(0.7)))), (0.4, leaf(0.3)),
             (0.4, node(1, 2.0, node(0, 0.5, leaf(1.5), leaf(-2.0)), leaf(0.125)))]
    rows = [(a, b) for a in (0.0, 0.5, 0.75) for b in (-1.0, -1e-5, 0.0, 2.0, 3.0)]
    found = spark.createDataFrame(rows, "a double, b double").select("a", "b", model(trees, 2).score(F.array("a", "b")).alias("p")).collect()

    def margin(a, b):
        first = -0.25 if a <= 0.5 else 0.1 if b <= -1e-5 else 0.7
        third = (1.5 if a <= 0.5 else -2.0) if b <= 2.0 else 0.125
        return 1.0 * first + 0.4 * 0.3 + 0.4 * third

    assert len(found) == len(rows)
    for row in found:
        assert abs(row["p"] - float(spark.range(1).select(1 / (1 + F.exp(F.lit(-2 * margin(row["a"], row["b"]))))).first()[0])) < 1e-12


def test_the_plan_does_not_grow_with_the_splits(spark):
    """One condition for every split made code of more than a Java method can hold (64 KB)."""
    def full(depth):
        return leaf(0.5) if depth == 0 else node(depth % 2, 0.25, full(depth - 1), full(depth - 1))

    scored = spark.createDataFrame([(0.0, 1.0)], "a double, b double").select(
        model([(0.4, full(5))] * 20, 5).score(F.array("a", "b")).alias("p"))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") <= 20
    assert scored.count() == 1


def test_the_fit_runs_a_few_jobs(spark):
    """A job for every level of every tree, each with broadcasts of its own, filled the driver's heap."""
    context = spark.sparkContext
    context.setJobGroup("fit-personal-data", "fit of the trees")
    try:
        fitted = pii.Model(spark)
        jobs = context.statusTracker().getJobIdsForGroup("fit-personal-data")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(fitted.trees) == 20 and all(len(flat[0]) == 31 and len(flat[2]) == 32 for _, flat in fitted.trees)
    assert 1 <= len(jobs) <= 6


def test_trees_are_those_of_spark(spark):
    """On features without ties, more distinct values than bins included."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    draw = random.Random(3)
    rows = [([float(draw.randint(0, 200)), draw.random(), float(draw.randint(0, 6))], 0) for _ in range(400)]
    rows = [(x, int(x[0] + 100 * x[1] + 7 * x[2] + draw.gauss(0, 30) > 170)) for x, _ in rows]
    known = spark.createDataFrame(rows, "features array<double>, label int").select(
        F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    theirs = GBTClassifier(maxIter=3, maxDepth=3, stepSize=0.4, seed=5).fit(known.coalesce(1))
    ours = boosting.fit([x for x, _ in rows], [y for _, y in rows], trees=3, depth=3, step=0.4)

    def value(node, x):
        while hasattr(node, "split"):
            node = node.leftChild() if x[node.featureIndex()] <= node.threshold() else node.rightChild()
        return node.prediction()

    assert [w for w, _ in ours] == list(theirs.treeWeights)
    for (_, root), tree in zip(ours, theirs.trees):
        for x, _ in rows[:25]:
            assert abs(value(root, x) - tree.predict(Vectors.dense(x))) < 1e-9


def test_ties_and_constant_features():
    once = boosting.fit([[0.0, 5.0, 5.0], [0.0, 6.0, 6.0]] * 3, [0, 1] * 3, trees=2, depth=5, step=0.4)
    assert once[0][1].featureIndex() == 1 and once[0][1].threshold() == 5.5  # of equal splits the first feature
    assert (once[0][1].leftChild().prediction(), once[0][1].rightChild().prediction()) == (-1.0, 1.0)
    same = boosting.fit([[1.0], [1.0]], [0, 1], trees=1, depth=5, step=0.4)
    assert same[0][1].prediction() == 0.0


def test_a_pure_node_is_a_leaf():
    """Its variance may be a little below zero by rounding; it never has an empty child."""
    def leaves(node):
        return [node.prediction()] if not hasattr(node, "split") else leaves(node.leftChild()) + leaves(node.rightChild())

    rows = [([float(i % 3), float(i % 7), float(i % 2)], int(i % 3 == 1)) for i in range(101)]
    made = boosting.fit([x for x, _ in rows], [y for _, y in rows], trees=20, depth=5, step=0.4)
    values = [v for _, root in made for v in leaves(root)]
    assert all(abs(v) < 4 for v in values) and [len(leaves(root)) for _, root in made] == [3] * 20
