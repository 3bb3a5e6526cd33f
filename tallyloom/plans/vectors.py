"""Vectors as images and latent points; small models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.catalog import query, table
from tallyloom.functions import random as R
from tallyloom.operators import vectors as V
from tallyloom.operators.resample import resampled, weights

#: Fixed weights by a rule: 8 inputs to 4 to 2, and back.
W1 = [[((3 * i + 7 * j) % 11 - 5) / 20 for i in range(64)] for j in range(4)]
B1 = [j / 10 for j in range(4)]
W2 = [[((5 * i + 2 * j) % 7 - 3) / 10 for i in range(4)] for j in range(2)]
B2 = [0.05, -0.05]
W3 = [[((i + 3 * j) % 5 - 2) / 4 for i in range(2)] for j in range(4)]
B3 = [j / 20 for j in range(4)]
LONG = "SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings"
SCALED = f"SELECT vec_id, label, pos, CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0 END AS x FROM ({LONG}) WINDOW w AS (PARTITION BY pos)"


def duck_dense(vector: str, weights, bias) -> str:
    return "[" + ", ".join(f"tanh(list_sum(list_transform(range(1, {len(w) + 1}), lambda kk: {vector}[kk] * ([{', '.join(map(str, w))}])[kk])) + {b})" for w, b in zip(weights, bias)) + "]"


def long_form(spark, sf_dir):
    return V.long_form(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"SELECT vec_id, pos, round(x, 6) AS x FROM ({SCALED})")
def vec_minmax(spark, sf_dir):
    return V.min_max(long_form(spark, sf_dir)).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"SELECT vec_id, pos, round(greatest(0, least(1, x + 0.5 * (((vec_id * 31 + pos * 17) % 100) / 100.0 - 0.5))), 6) AS x FROM ({SCALED})")
def img_noise_clip(spark, sf_dir):
    """Scaled pixels with noise of factor one half, clipped; the noise is a fixed function of the place."""
    noise = ((F.col("vec_id") * 31 + F.col("pos") * 17) % 100) / 100.0 - 0.5
    return V.min_max(long_form(spark, sf_dir)).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(V.clip(F.col("x") + 0.5 * noise), 6).alias("x"))


@query(f"SELECT vec_id, (pos // 8 // 2 * 4 + pos % 8 // 2)::BIGINT AS pos, round(avg(x), 6) AS x FROM ({LONG}) GROUP BY 1, 2")
def img_downsample(spark, sf_dir):
    return V.downsample(long_form(spark, sf_dir), "vec_id", 8).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"SELECT vec_id, round(z[1], 5) AS z1, round(z[2], 5) AS z2 FROM (SELECT vec_id, {duck_dense('h', W2, B2)} AS z FROM (SELECT vec_id, {duck_dense('embedding', W1, B1)} AS h FROM embeddings))")
def ae_encode(spark, sf_dir):
    hidden = table(spark, sf_dir, "embeddings").select("vec_id", V.dense(F.col("embedding").cast("array<double>"), W1, B1).alias("h"))
    z = hidden.select("vec_id", V.dense(F.col("h"), W2, B2).alias("z"))
    return z.select("vec_id", F.round(F.get("z", F.lit(0)), 5).alias("z1"), F.round(F.get("z", F.lit(1)), 5).alias("z2"))


@query(f"SELECT vec_id, round(y[1], 6) AS y1, round(y[2], 6) AS y2, round(y[3], 6) AS y3, round(y[4], 6) AS y4 FROM (SELECT vec_id, {duck_dense('z', W3, B3)} AS y FROM (SELECT vec_id, {duck_dense('h', W2, B2)} AS z FROM (SELECT vec_id, {duck_dense('embedding', W1, B1)} AS h FROM embeddings)))")
def ae_decode(spark, sf_dir):
    """The latent point of every vector, decoded."""
    hidden = table(spark, sf_dir, "embeddings").select("vec_id", V.dense(F.col("embedding").cast("array<double>"), W1, B1).alias("h"))
    points = hidden.select("vec_id", V.dense(F.col("h"), W2, B2).alias("z"))
    y = points.select("vec_id", V.dense(F.col("z"), W3, B3).alias("y"))
    return y.select("vec_id", *[F.round(F.get("y", F.lit(k)), 6).alias(f"y{k + 1}") for k in range(4)])


LATENT = "SELECT vec_id, label, unnest(range(0, 32)) AS pos, unnest(embedding[1:32])::DOUBLE AS mu, unnest(embedding[33:64])::DOUBLE / 4 AS lv FROM embeddings"


def latent(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    pairs = F.arrays_zip(F.slice(v, 1, 32).alias("mu"), F.slice(v, 33, 32).alias("lv"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(pairs).alias("pos", "p"))
    return rows.select("vec_id", "label", "pos", F.col("p.mu").alias("mu"), (F.col("p.lv") / 4).alias("lv"))


@query(f"SELECT vec_id, pos, round(mu + exp(0.5 * lv) * (((vec_id + 3 * pos) % 11) / 5.0 - 1), 6) AS z FROM ({LATENT})")
def vae_reparam(spark, sf_dir):
    eps = ((F.col("vec_id") + 3 * F.col("pos")) % 11) / 5.0 - 1
    return latent(spark, sf_dir).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(V.reparameterise(F.col("mu"), F.col("lv"), eps), 6).alias("z"))


@query(f"SELECT label, round(avg(k), 5) AS kl FROM (SELECT vec_id, label, sum(-0.5 * (1 + lv - mu * mu - exp(lv))) AS k FROM ({LATENT}) GROUP BY 1, 2) GROUP BY 1")
def vae_kl_sum(spark, sf_dir):
    """Summed over dimensions, then averaged."""
    each = latent(spark, sf_dir).groupBy("vec_id", "label").agg(F.sum(V.kl(F.col("mu"), F.col("lv"))).alias("k"))
    return each.groupBy("label").agg(F.round(F.avg("k"), 5).alias("kl"))


@query(f"SELECT label, round(avg(-0.5 * (1 + lv - mu * mu - exp(lv))), 6) AS kl FROM ({LATENT}) GROUP BY 1")
def vae_kl_mean(spark, sf_dir):
    """Averaged over everything."""
    return latent(spark, sf_dir).groupBy("label").agg(F.round(F.avg(V.kl(F.col("mu"), F.col("lv"))), 6).alias("kl"))


RECON = "0.1 + 0.8 * x"


@query(f"SELECT vec_id, round(sum(-(x * ln({RECON}) + (1 - x) * ln(1 - ({RECON})))), 5) AS loss FROM ({SCALED}) GROUP BY 1")
def loss_bce(spark, sf_dir):
    x = F.col("x")
    return V.min_max(long_form(spark, sf_dir)).groupBy("vec_id").agg(F.round(F.sum(V.cross_entropy(x, 0.1 + 0.8 * x)), 5).alias("loss"))


@query(f"SELECT vec_id, round(avg(pow(x - ({RECON}), 2)), 7) AS loss FROM ({SCALED}) GROUP BY 1")
def loss_mse(spark, sf_dir):
    d = F.col("x") - (0.1 + 0.8 * F.col("x"))
    return V.min_max(long_form(spark, sf_dir)).groupBy("vec_id").agg(F.round(F.avg(d * d), 7).alias("loss"))


@query("SELECT label, i, j, round(top * (-1 + 2 * i / 29.0), 6) AS x, round(top * (1 - 2 * j / 29.0), 6) AS y FROM (SELECT label, max(greatest(abs(embedding[1]::DOUBLE), abs(embedding[2]::DOUBLE))) AS top FROM embeddings GROUP BY 1), range(0, 30) a(i), range(0, 30) b(j)")
def latent_grid(spark, sf_dir):
    """For each label a grid of thirty by thirty points over the square that its first two numbers span, y from the top."""
    first = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
    spans = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(F.greatest(first(0), first(1))).alias("top"))
    steps = F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))
    cells = spans.select("label", "top", F.explode(steps).alias("i")).select("label", "top", "i", F.explode(steps).alias("j"))
    return cells.select("label", "i", "j", F.round(F.col("top") * (-1 + 2 * F.col("i") / 29.0), 6).alias("x"), F.round(F.col("top") * (1 - 2 * F.col("j") / 29.0), 6).alias("y"))


@query(f"SELECT vec_id, pos, round(greatest(0, least(1, x + 0.5 * {R.normal_sql(11, 'vec_id', 'pos')})), 6) AS x FROM ({SCALED})")
def img_noise_gauss(spark, sf_dir):
    """Scaled pixels with normal noise of factor one half, clipped; drawn by vector and place."""
    noise = R.normal(11, F.col("vec_id"), F.col("pos"))
    return V.min_max(long_form(spark, sf_dir)).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(V.clip(F.col("x") + 0.5 * noise), 6).alias("x"))


@query(f"SELECT vec_id, pos, round(mu + exp(0.5 * lv) * {R.normal_sql(12, 'vec_id', 'pos')}, 6) AS z FROM ({LATENT})")
def vae_sample(spark, sf_dir):
    """Reparameterised points with normal draws."""
    return latent(spark, sf_dir).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(V.reparameterise(F.col("mu"), F.col("lv"), R.normal(12, F.col("vec_id"), F.col("pos"))), 6).alias("z"))


@query(f"SELECT label, k, pos, round(mu + sd * {R.normal_sql(13, 'label', 'k', 'pos')}, 6) AS z FROM (SELECT label, pos, avg(x) AS mu, stddev_pop(x) AS sd FROM ({LONG}) GROUP BY 1, 2), range(0, 20) r(k)")
def latent_random(spark, sf_dir):
    """Twenty random points for each label, as normal as its vectors are in each dimension."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    spread = rows.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    points = spread.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("k"))
    return points.select("label", "k", "pos", F.round(F.col("mu") + F.col("sd") * R.normal(13, F.col("label"), F.col("k"), F.col("pos")), 6).alias("z"))


def resample_sql(to: tuple[int, int], name: str) -> str:
    pairs = [(i, j, sum_) for i, w in enumerate(weights(8, to[0], name)) for j, sum_ in enumerate(w) if sum_]
    across = [(i, j, x) for i, w in enumerate(weights(8, to[1], name)) for j, x in enumerate(w) if x]
    values = lambda rows: ", ".join(f"({i}, {j}, {x!r}::DOUBLE)" for i, j, x in rows)
    return f"""WITH d(o, a, w) AS (VALUES {values(pairs)}), c(p, b, v) AS (VALUES {values(across)})
SELECT vec_id, (o * {to[1]} + p)::BIGINT AS pos, round(sum(x * w * v), 5) AS x FROM ({LONG}) l JOIN d ON d.a = l.pos // 8 JOIN c ON c.b = l.pos % 8 GROUP BY 1, 2"""


def resampled_images(spark, sf_dir, to, name):
    pixels = resampled(F.col("embedding").cast("array<double>"), (8, 8), to, name)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(pixels).alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query(resample_sql((5, 3), "bicubic"))
def img_resample_bicubic(spark, sf_dir):
    """Vectors as images of 8 x 8, shrunk to 5 x 3."""
    return resampled_images(spark, sf_dir, (5, 3), "bicubic")


@query(resample_sql((14, 14), "bilinear"))
def img_resample_bilinear(spark, sf_dir):
    """The same, stretched to 14 x 14."""
    return resampled_images(spark, sf_dir, (14, 14), "bilinear")


@query(resample_sql((4, 4), "box"))
def img_resample_box(spark, sf_dir):
    return resampled_images(spark, sf_dir, (4, 4), "box")


@query()
def words_pca2(spark, sf_dir):
    """The hundred most frequent words on two principal components of their vectors."""
    from tallyloom.functions.text import letter_tokens
    from tallyloom.operators.components2d import principal_components
    from tallyloom.operators.word2vec import train_vectors

    words = table(spark, sf_dir, "documents").select(letter_tokens(F.col("text")).alias("words"))
    most = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(100)
    vectors = train_vectors(words)
    places = principal_components(vectors.join(F.broadcast(most.select("word")), "word"), "word", "vector")
    return places.select("word", F.round("pc1", 4).alias("pc1"), F.round("pc2", 4).alias("pc2"))


@query(f"SELECT label, pos, round(avg(x), 6) AS x FROM ({LONG}) GROUP BY 1, 2")
def latent_centroids(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return rows.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("x"), 6).alias("x"))


@query()
def latent_neighbours(spark, sf_dir):
    """All vectors in a plane that keeps their neighbours, at perplexity 30 after 1,000 iterations."""
    from tallyloom.operators.neighbour_map import neighbour_map

    return neighbour_map(table(spark, sf_dir, "embeddings"))


def colour_sql(t: str) -> str:
    last = len(V.PUOR) - 1
    x = f"(greatest(0.0, least(1.0, {t})) * {last})"
    at = f"least(floor({x}), {last - 1})::INTEGER"
    parts = []
    for channel in range(3):
        values = "[" + ", ".join(f"{V.rgb(s)[channel]}::DOUBLE" for s in V.PUOR) + "]"
        parts.append(f"floor({values}[{at} + 1] + ({values}[{at} + 2] - {values}[{at} + 1]) * ({x} - {at}) + 0.5)::INTEGER")
    return "'rgb(' || " + " || ',' || ".join(parts) + " || ')'"


@query(f"WITH t AS (SELECT vec_id, pos, round((x / (SELECT max(abs(x)) FROM ({LONG})) + 1) / 2, 6) AS t, round(1 / (1 + exp(-5 * x)), 6) AS s FROM ({LONG})) SELECT *, {colour_sql('t')} AS colour FROM t")
def vec_barcode(spark, sf_dir):
    """Places on a two-sided colour scale, by the greatest absolute value and by a sigmoid; the colour at the first."""
    rows = long_form(spark, sf_dir)
    top = rows.agg(F.max(F.abs("x")).alias("top"))
    out = rows.crossJoin(F.broadcast(top))
    places = out.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round((F.col("x") / F.col("top") + 1) / 2, 6).alias("t"), F.round(1 / (1 + F.exp(-5 * F.col("x"))), 6).alias("s"))
    return places.withColumn("colour", V.colour(F.col("t")))


@query()
def vec_pca2(spark, sf_dir):
    """Two principal components of centred vectors, each turned so that its greatest weight is positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    model = PCA(k=2, inputCol="c", outputCol="p").fit(centred)
    signs = [1.0 if max(column, key=abs) > 0 else -1.0 for column in model.pc.toArray().T.tolist()]
    out = model.transform(centred).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", *[F.round(F.get("p", F.lit(k)) * signs[k], 6).alias(f"pc{k + 1}") for k in (0, 1)])


@query()
def ml_tree_accuracy(spark, sf_dir):
    """A tree of depth 4 on labels 1, 2 and 8: rows and share of right answers on the held-out part."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    from tallyloom.operators.profile import hash_bucket

    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 2, 8)).select(F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), hash_bucket(F.col("vec_id")).alias("b"))
    model = DecisionTreeClassifier(maxDepth=4, seed=1).fit(rows.where("b < 70"))
    return model.transform(rows.where("b >= 70")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy"))


@query()
def ae_train(spark, sf_dir):
    """A small autoencoder per label, trained on all of its vectors: loss of the first and the last epoch."""
    from tallyloom.operators.autoencoder import train

    rows = table(spark, sf_dir, "embeddings").where("label in (1, 2, 8)").select("label", F.col("embedding").alias("x"))
    losses = {label: losses for label, (_, losses) in train(rows, "label", "x", epochs=25).items()}
    return spark.createDataFrame([(int(k), v[0], v[-1]) for k, v in sorted(losses.items())], "label int, first_loss double, last_loss double")


def epochs_frame(spark, history):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(history)], "epoch long, reconstruction double, divergence double")


@query()
def ae_deep_train(spark, sf_dir):
    """An autoencoder 100-50-2-50-100 on all vectors: the mean squared error of each epoch."""
    from tallyloom.operators.networks import Plain, train

    _, history = train(table(spark, sf_dir, "embeddings"), Plain(64), "vec_id", "embedding", epochs=6, batches=4, rate=0.003)
    return epochs_frame(spark, history).drop("divergence")


@query()
def vae_train(spark, sf_dir):
    """A variational autoencoder on all vectors, scaled by the greatest absolute value to [0, 1]: both parts of the loss by epoch."""
    from tallyloom.operators.networks import Variational, train

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    top = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    _, history = train(rows.select("vec_id", F.transform("v", lambda x: (x / top + 1) / 2).alias("x")), Variational(64), "vec_id", "x", epochs=6, batches=4, rate=0.01)
    return epochs_frame(spark, history)
