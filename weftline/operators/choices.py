"""Multiple choice: rendering, conversations, losses to predictions, accuracy, confusion and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.byte_vocab import byte_ids
from weftline.operators.prefix import prefix_fold, range_buckets

#: The prompt's first words and its last line.
HEAD, TAIL = "Multiple Choice question: ", "\nRespond only with the letter of the correct answer."
#: The subjects of the four-choice benchmark.
SUBJECTS = (
    "abstract_algebra", "anatomy", "astronomy", "business_ethics", "clinical_knowledge", "college_biology", "college_chemistry",
    "college_computer_science", "college_mathematics", "college_medicine", "college_physics", "computer_security", "conceptual_physics",
    "econometrics", "electrical_engineering", "elementary_mathematics", "formal_logic", "global_facts", "high_school_biology",
    "high_school_chemistry", "high_school_computer_science", "high_school_european_history", "high_school_geography",
    "high_school_government_and_politics", "high_school_macroeconomics", "high_school_mathematics", "high_school_microeconomics",
    "high_school_physics", "high_school_psychology", "high_school_statistics", "high_school_us_history", "high_school_world_history", "human_aging",
    "human_sexuality", "international_law", "jurisprudence", "logical_fallacies", "machine_learning", "management", "marketing", "medical_genetics",
    "miscellaneous", "moral_disputes", "moral_scenarios", "nutrition", "philosophy", "prehistory", "professional_accounting", "professional_law",
    "professional_medicine", "professional_psychology", "public_relations", "security_studies", "sociology", "us_foreign_policy", "virology",
    "world_religions",
)


def choice_prompt(question: Column, letters: Column, choices: Column) -> Column:
    n = F.least(F.size(letters), F.size(choices))
    lines = F.zip_with(F.slice(letters, F.lit(1), n), F.slice(choices, F.lit(1), n), lambda a, c: F.concat(F.lit("- "), c, F.lit("="), a, F.lit("\n")))
    return F.concat(F.lit(HEAD), question, F.lit("\n"), F.array_join(lines, ""), F.lit(TAIL))


def four_choice(rows: DataFrame) -> DataFrame:
    """question, choices, answer (0-3), subject to prompt, reply, subject, letters; rows without four choices are wrong."""
    letters = F.array(*map(F.lit, "ABCD"))
    ok = rows.withColumn("is_valid", F.size("choices") == 4)
    return ok.select("item", choice_prompt(F.col("question"), letters, F.col("choices")).alias("prompt"), F.get(letters, F.col("answer")).alias("reply"), "subject", "is_valid")


def lettered(rows: DataFrame) -> DataFrame:
    """question, choices, letters, answer (a letter); the answer must be among the letters."""
    return rows.select("item", choice_prompt(F.col("question"), F.col("letters"), F.col("choices")).alias("prompt"), F.col("answer").alias("reply"), "letters", F.array_contains("letters", F.col("answer")).alias("is_valid"))


def categorical(response: Column, gold: Column, letters: Column) -> Column:
    """Whether the response is right; null where it is none of the letters."""
    return F.when(F.array_contains(letters, response), response == gold)


def completion_tokens(items: DataFrame) -> DataFrame:
    """item, choice, label, ids, mask: the context's tokens (mask 0), then a space and the ending's (mask 1)."""
    e = items.select("item", "label", byte_ids(F.col("ctx")).alias("head"), F.posexplode("endings").alias("choice", "ending"))
    tail = byte_ids(F.concat(F.lit(" "), F.col("ending")))
    return e.withColumn("tail", tail).select("item", "choice", "label", F.concat("head", "tail").alias("ids"), F.concat(F.array_repeat(F.lit(0), F.size("head")), F.array_repeat(F.lit(1), F.size("tail"))).alias("mask"))


def masked_losses(tokens: DataFrame) -> DataFrame:
    """tokens: item, choice, label, pos, mask, loss (of the token at pos, seen from the one before). Sum and mean over mask 1, the first token never counting.

    Losses are added up in the order of their places, so that equal choices have equal sums to the last bit, however rows are dealt to tasks.
    """
    seen = F.when(F.col("loss").isNotNull(), F.struct("pos", "loss"))
    told = tokens.filter("mask = 1 and pos > 0").groupBy("item", "choice", "label").agg(F.transform(F.array_sort(F.collect_list(seen)), lambda x: x["loss"]).alias("l_"))
    total = F.when(F.size("l_") > 0, F.aggregate("l_", F.lit(0.0), lambda a, x: a + x))
    return told.select("item", "choice", "label", total.alias("loss_sum"), (total / F.size("l_")).alias("loss_mean"))


def predictions(losses: DataFrame) -> DataFrame:
    """item, label, pred (least sum), pred_norm (least mean); ties to the lowest choice."""
    best = lambda c: F.min(F.struct(c, "choice"))["choice"]
    return losses.groupBy("item", "label").agg(best("loss_sum").alias("pred"), best("loss_mean").alias("pred_norm"))


def running_accuracy(preds: DataFrame, order: str = "item") -> DataFrame:
    """Running accuracies by item, bucket by bucket, so that no task holds them all. Predictions of nothing, or against no label, are left out of the ratios."""
    hit = lambda c: (F.col(c) == F.col("label")).cast("int")
    s = preds.select(order, F.lit(1).alias("one_"), hit("pred").alias("a_"), hit("pred_norm").alias("b_"))
    s = s.withColumn("an_", F.col("a_").isNotNull().cast("int")).withColumn("bn_", F.col("b_").isNotNull().cast("int"))
    s = prefix_fold(range_buckets(s, order, "bucket_"), {"n": (F.sum, "one_"), "as_": (F.sum, "a_"), "bs_": (F.sum, "b_"), "ac_": (F.sum, "an_"), "bc_": (F.sum, "bn_")}, order, "bucket_")
    return s.select(order, F.col("n").cast("long").alias("n"), F.try_divide("as_", "ac_").alias("acc"), F.try_divide("bs_", "bc_").alias("acc_norm"))


def first_items(running: DataFrame, most: int) -> DataFrame:
    """The rows of running accuracies up to the `most`-th item, that one included."""
    return running.filter(F.col("n") <= most)


def class_report(preds: DataFrame, classes: int = 4, pred: str = "pred") -> DataFrame:
    """class, tp, fp, fn, precision, recall, f1 of every class, absent ones included; 0 where a denominator is 0."""
    spark = preds.sparkSession
    conf = preds.groupBy(F.col(pred).alias("p"), F.col("label").alias("a")).agg(F.count("*").alias("c"))
    dim = spark.range(classes).select(F.col("id").cast("int").alias("class"))
    hits = F.col("p") == F.col("class")
    acts = F.col("a") == F.col("class")
    # a class meets the cells of its row and its column: conf has classes ** 2 rows at most
    cells = conf.withColumn("class", F.explode(F.array_distinct(F.array("p", "a"))))
    s = dim.join(cells, "class", "left").groupBy("class").agg(
        *(F.coalesce(F.sum(F.when(c, F.col("c"))), F.lit(0)).alias(n) for n, c in (("tp", hits & acts), ("fp", hits & ~acts), ("fn", ~hits & acts)))
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy_report(preds: DataFrame, classes: int = 4) -> DataFrame:
    """One row: num_total, num_correct, num_correct_norm, acc, acc_norm, macro_f1 (the mean over all classes)."""
    hit = lambda c: F.count_if(F.col(c) == F.col("label"))
    total = preds.agg(F.count("*").alias("num_total"), hit("pred").alias("num_correct"), hit("pred_norm").alias("num_correct_norm"))
    macro = class_report(preds, classes).agg(F.avg("f1").alias("macro_f1"))
    share = lambda c: (F.col(c) / F.greatest(F.col("num_total"), F.lit(1)))
    return total.join(F.broadcast(macro)).select("num_total", "num_correct", "num_correct_norm", share("num_correct").alias("acc"), share("num_correct_norm").alias("acc_norm"), "macro_f1")
