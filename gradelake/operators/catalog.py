"""Answer-key catalogue: keys, models and their questions as batch table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.coords import _c
from gradelake.functions.text import leading_int
from gradelake.operators.keyed import block_of, count_per, first_wins, last_wins, latest, split_rank

# Booklet types and languages the catalogue accepts.
BOOKLET_TYPES = ("standard", "custom", "custom_with_model", "essay")
LANGUAGES = ("en", "hi")
MODEL_COLUMNS = (
    "id owner_user_id title lang booklet_type booklet_pdf_path question_count intro_page created_seq".split()
)


# ---- domains and defaults -------------------------------------------------

def booklet_type(raw) -> Column:
    t = F.lower(F.trim(F.coalesce(_c(raw), F.lit("standard"))))
    return F.when(t.isin(*BOOKLET_TYPES), t).otherwise("standard")


def check_level(raw) -> Column:
    """Moderate or Hard; empty string marks a value to reject."""
    t = F.lower(F.trim(F.when(_c(raw) == "", F.lit("Moderate")).otherwise(F.coalesce(_c(raw), F.lit("Moderate")))))
    return F.when(t == "hard", "Hard").when(t == "moderate", "Moderate").otherwise("")


def valid_lang(raw) -> Column:
    return F.lower(F.trim(F.coalesce(_c(raw), F.lit("")))).isin(*LANGUAGES)


def apply_domains(df: DataFrame) -> DataFrame:
    """Canonical booklet_type, lang and check_level plus a reject reason."""
    level = check_level("check_level")
    return df.withColumns({
        "booklet_type": booklet_type("booklet_type"),
        "lang": F.lower(F.trim("lang")),
        "check_level": level,
        "reject": F.when(~valid_lang("lang"), "language").when(level == "", "check_level"),
    })


def for_owner(df: DataFrame, owner) -> DataFrame:
    return df.filter(F.col("owner_user_id") == owner)


def instruction_default(name="instruction_name") -> Column:
    return F.coalesce(_c(name).cast("string"), F.lit(""))


def normalize_questions(raw: DataFrame) -> DataFrame:
    """Typed question rows from loosely typed extraction output (all strings, nullable)."""
    def text(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)).alias(name)

    keep = [c for c in raw.columns if c not in
            ("id", "question_no", "title", "desc_text", "instruction_name", "page_num", "marks", "diagrams")]
    diagrams = F.coalesce(F.col("diagrams"), F.array()) if "diagrams" in raw.columns else F.array()
    return raw.select(
        *keep, text("id", "q-eng-001"), text("question_no", "Q1"), text("title", ""), text("desc_text", ""),
        text("instruction_name", ""),
        F.coalesce(F.col("page_num").try_cast("int"), F.lit(1)).alias("page_num"),
        leading_int("marks").alias("marks"), diagrams.cast("array<string>").alias("diagrams"),
    )


def normalize_imported(raw: DataFrame) -> DataFrame:
    """Trim imported rows, drop those without text, fill id and number."""
    def trimmed(name: str) -> Column:
        return F.trim(F.coalesce(F.col(name), F.lit("")))

    return (
        raw.withColumn("question_text", trimmed("question_text"))
        .filter(F.col("question_text") != "")
        .withColumn("id", F.coalesce(F.nullif(trimmed("id"), F.lit("")), F.lit("q-unknown")))
        .withColumn("question_no", F.coalesce(F.nullif(trimmed("question_no"), F.lit("")), F.lit("Q?")))
    )


def canonical_questions(df: DataFrame) -> DataFrame:
    """Question/answer rows (with a 1-based pos) in the stored question shape."""
    def or_default(name: str, default: Column) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), default)

    pos = F.col("pos").cast("int")
    return df.select(
        "model_id", "pos",
        or_default("question_id", F.format_string("q-%03d", pos)).alias("id"),
        or_default("question_no", F.format_string("Q%d", pos)).alias("question_no"),
        F.coalesce("question", F.lit("")).alias("title"), F.coalesce("answer", F.lit("")).alias("desc_text"),
        F.lit("").alias("instruction_name"), F.lit(1).alias("page_num"), F.lit(0).alias("marks"),
        F.array().cast("array<string>").alias("diagrams"),
    )


def newest_first(listed: DataFrame, out: str = "rank") -> DataFrame:
    """Number the listed models of each owner from the newest on; a large owner is numbered in blocks."""
    newest = -F.col("created_seq")
    return split_rank(listed, ["owner_user_id"], [newest, F.col("id")], [block_of(newest)], out)


# ---- numbering ------------------------------------------------------------

def renumber(questions: DataFrame, pos: str = "pos") -> DataFrame:
    """question_no = Q1..Qn in position order, pos becomes dense."""
    ranked = split_rank(questions, ["model_id"], [pos], [block_of(pos)], "_n")
    return ranked.withColumn(pos, F.col("_n")).withColumn("question_no", F.concat(F.lit("Q"), "_n")).drop("_n")


def default_pages_marks(questions: DataFrame) -> DataFrame:
    """First half of a model on page 2 with 8 marks, second half on page 3 with 12.

    Pages are always set, marks only where they are 0.
    """
    ranked = split_rank(questions, ["model_id"], ["pos"], [block_of("pos")], "_i")
    sized = ranked.join(count_per(questions, ["model_id"], "_n"), "model_id")
    first = F.col("_i") <= F.floor(F.col("_n") / F.lit(2.0))
    return (
        sized.withColumn("page_num", F.when(first, 2).otherwise(3))
        .withColumn("marks", F.when(F.col("marks") == 0, F.when(first, 8).otherwise(12)).otherwise(F.col("marks")))
        .drop("_i", "_n")
    )


# Fixed value: where questions without a label stand.
BLANK_LABEL = "999999"


def question_order_key(question_no) -> Column:
    """Sort string of a label: numbers before letters, prefix Q ignored.

    Each token becomes ``0``, the number of digits and the digits, or ``1`` and the
    lower-case letters, closed by a character that sorts before all of them; so
    comparing the strings compares the token lists, however long the numbers are.
    """
    label = F.trim(_c(question_no))
    bare = F.regexp_replace(label, r"(?i)^Q\s*", "")
    tokens = F.regexp_extract_all(bare, F.lit(r"([0-9]+|[a-zA-Z]+)"), 1)

    def digits(t: Column) -> Column:
        bare = F.ltrim(t, F.lit("0"))
        return F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 10, "0"), bare)

    def part(t: Column) -> Column:
        shown = F.when(t.rlike("^[0-9]"), digits(t)).otherwise(F.concat(F.lit("1"), F.lower(t)))
        return F.concat(shown, F.lit("\u0001"))

    blank = F.concat(digits(F.lit(BLANK_LABEL)), F.lit("\u00011"), F.lower(label))
    return F.when(F.size(tokens) > 0, F.array_join(F.transform(tokens, part), "")).otherwise(blank)


def logical_order(questions: DataFrame) -> DataFrame:
    """Number questions by label (Q2 before Q10, 2(a) before 2(b)); ids become q-001...

    Blocks are the first digits of the labels, so a model with very many labels has few blocks and
    none of them holds all of its questions.
    """
    keyed = questions.withColumn("_key", question_order_key("question_no"))
    ranked = split_rank(keyed, ["model_id"], ["_key", "pos"], [F.substring("_key", 1, 14)], "new_pos")
    return ranked.withColumn("new_id", F.format_string("q-%03d", "new_pos")).drop("_key")


def next_question_id(questions: DataFrame) -> DataFrame:
    """Next free q-eng-NNN per model."""
    return questions.groupBy("model_id").agg(
        F.format_string("q-eng-%03d", F.coalesce(F.max(question_number()), F.lit(0)) + 1).alias("next_id")
    )


def question_number() -> Column:
    """The number of an id q-eng-NNN, null for any other id."""
    return F.regexp_extract(F.trim("id"), r"(?i)^q-eng-([0-9]+)$", 1).try_cast("int")


def key_text(questions: DataFrame, titles: DataFrame, per_part: int = 256) -> DataFrame:
    """Answer-key text per model, in parts of at most ``per_part`` questions.

    Joining the parts of a model in order (with a line break) gives the whole
    text; no model needs to fit in one value.
    """
    no = F.trim(F.coalesce("question_no", F.lit("?")))
    label = F.when((no != "?") & ~F.upper(no).startswith("Q"), F.concat(F.lit("Q"), no)).otherwise(no)

    def line(prefix: str, c: Column) -> Column:
        return F.when(c != "", F.concat(F.lit(prefix), c))

    block = F.concat_ws(
        "\n", F.concat(label, F.lit(". "), F.trim(F.coalesce("title", F.lit("")))),
        line("   Model booklet (ideal answer): ", F.trim(F.coalesce("desc_text", F.lit("")))),
        line("   Instructions (examiner marking key — weigh like the booklet text): ",
             F.trim(F.coalesce("instruction_name", F.lit("")))),
        line("   Diagrams/Key points: ", F.array_join("diagrams", "; ")) if "diagrams" in questions.columns else F.lit(None),
        F.concat(F.lit("   MAX MARKS ALLOWED: "), F.coalesce("marks", F.lit(0)).cast("string")), F.lit(""),
    )
    part = F.floor((F.col("pos") - 1) / F.lit(float(per_part))).cast("int")
    parts = questions.groupBy("model_id", part.alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("t")))), lambda x: x["t"]),
                     "\n").alias("text")
    )
    head = F.concat(F.lit("Subject / Paper: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("General")), F.lit("\n\n"))
    return parts.join(titles.select("model_id", "title"), "model_id").select(
        "model_id", "part", F.when(F.col("part") == 0, F.concat(head, "text")).otherwise(F.col("text")).alias("text")
    )


def whole_key_text(questions: DataFrame, titles: DataFrame, per_part: int = 256) -> DataFrame:
    """One answer-key text per model (model_id, text), as a grading model reads it; for models whose questions fit in one value.

    The parts of ``key_text`` are joined, so a task sorts a model's parts and not its questions. A model without questions has only the heading.
    """
    parts = key_text(questions, titles, per_part).groupBy("model_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("text"))
    bare = F.concat(F.lit("Subject / Paper: "), F.coalesce(F.nullif("title", F.lit("")), F.lit("General")), F.lit("\n"))
    return titles.select("model_id", "title").join(parts, "model_id", "left").select("model_id", F.coalesce("text", bare).alias("text"))


# ---- lookups --------------------------------------------------------------

def list_models(keys: DataFrame, models: DataFrame) -> DataFrame:
    """Every key with whether its booklet was processed; sort by created_seq for display."""
    m = models.select("id", "owner_user_id", F.col("booklet_type").alias("_m_type"), F.lit(True).alias("_has"))
    return keys.join(m, ["id", "owner_user_id"], "left").select(
        "id", "owner_user_id", "title", "lang", F.coalesce("_has", F.lit(False)).alias("has_booklet"),
        F.coalesce("_m_type", "booklet_type").alias("booklet_type"), "created_seq",
    )


def question_for(requests: DataFrame, models: DataFrame, questions: DataFrame) -> DataFrame:
    """Look a question up for (model_id, owner, question_id); says which part is missing."""
    m = models.select(F.col("id").alias("model_id"), "owner_user_id", F.lit(True).alias("_m"))
    q = first_wins(questions.select("model_id", F.col("id").alias("question_id"), "title", "marks", "pos"),
                   ["model_id", "question_id"], "pos").drop("pos").withColumn("_q", F.lit(True))
    joined = requests.join(m, ["model_id", "owner_user_id"], "left").join(q, ["model_id", "question_id"], "left")
    error = F.when(F.col("_m").isNull(), "Model not found.").when(F.col("_q").isNull(), "Question not found for this model.")
    ok = error.isNull()
    return joined.select(*requests.columns, error.alias("error"), F.when(ok, F.col("title")).alias("title"),
                         F.when(ok, F.col("marks")).alias("marks"))


def resolve_language(requests: DataFrame, models: DataFrame) -> DataFrame:
    """A valid explicit language wins, then the model's, then English; else an error."""
    m = models.select(F.col("id").alias("model_id"), "owner_user_id", F.lower(F.trim("lang")).alias("_ml"), F.lit(True).alias("_m"))
    asked = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    explicit, has_model = asked.isin(*LANGUAGES), F.col("model_id").isNotNull()
    model_ok = F.col("_ml").isin(*LANGUAGES)
    lang = (
        F.when(explicit, asked).when(has_model & model_ok, F.col("_ml")).when(~has_model & (asked == ""), "en")
    )
    error = (
        F.when(explicit, None)
        .when(has_model & F.col("_m").isNull(), "Model not found.")
        .when(has_model & ~F.coalesce(model_ok, F.lit(False)), "Model language must be en or hi for OCR.")
        .when(~has_model & (asked != ""), "language must be en or hi")
    )
    return requests.join(m, ["model_id", "owner_user_id"], "left").select(
        *requests.columns, lang.alias("resolved"), error.alias("error"))


def grading_context(requests: DataFrame, models: DataFrame, questions: DataFrame) -> DataFrame:
    """Gate a grading request; ``error`` is the first rule that fails."""
    m = models.select(F.col("id").alias("model_id"), "owner_user_id", F.lower(F.trim("lang")).alias("_lang"), F.lit(True).alias("_m"))
    q = first_wins(
        questions.select("model_id", F.col("id").alias("question_id"), "title", "desc_text", "marks", "page_num", "pos"),
        ["model_id", "question_id"], "pos").drop("pos").withColumn("_q", F.lit(True))
    j = requests.join(m, ["model_id", "owner_user_id"], "left").join(q, ["model_id", "question_id"], "left")
    level = check_level("check_level")

    def blank(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    error = (
        F.when(F.col("_m").isNull(), "Model not found.")
        .when(~F.coalesce(F.col("_lang").isin(*LANGUAGES), F.lit(False)), "Model language must be en or hi for analysis.")
        .when(F.col("_q").isNull(), "Question not found for this model.")
        .when(blank("title") | blank("desc_text"), "Stored question is missing title or desc.")
        .when(F.coalesce("marks", F.lit(0)) < 1, "Stored question marks must be at least 1 for analysis.")
        .when(level == "", "checkLevel must be Moderate or Hard.")
    )
    ok = error.isNull()
    return j.select(*[c for c in requests.columns if c != "check_level"], error.alias("error"),
                    F.when(ok, level).alias("check_level"), F.when(ok, F.col("marks")).alias("total_marks"),
                    F.when(ok, F.greatest(F.lit(1), F.coalesce("page_num", F.lit(1)))).alias("page_count"))


def review_rows(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Question results joined to the key; one unknown question rejects its whole request.

    ``results`` carries request_id, model_id, question_id, marks_awarded.
    """
    q = last_wins(questions.select("model_id", F.col("id").alias("question_id"), "question_no", "title",
                                   F.col("marks").alias("marks_total"), "pos"), ["model_id", "question_id"], "pos").drop("pos")
    j = results.join(q.withColumn("_q", F.lit(True)), ["model_id", "question_id"], "left")
    bad = results.join(q, ["model_id", "question_id"], "left_anti").select("request_id").distinct()
    return j.join(bad, "request_id", "left_anti").select(
        *results.columns, F.coalesce("question_no", F.lit("")).alias("question_no"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("marks_total", F.lit(0)).alias("marks_total"))


def stamp(df: DataFrame, id_col: str = "id") -> DataFrame:
    """New rows get a random id and the creation time.

    Both differ from run to run: write the result before using it twice.
    """
    return df.withColumn(id_col, F.uuid()).withColumn("created_at", F.current_timestamp())


# ---- writes ---------------------------------------------------------------

def delete_keys(keys: DataFrame, models: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove keys (id, owner) and their models; third result lists the files to remove."""
    on = ["id", "owner_user_id"]
    gone = ids.select(*on).distinct()
    hit = keys.join(gone, on).select(*on, "pdf_path")
    files = hit.join(models.select(*on, "booklet_pdf_path"), on, "left")
    left_models = models.join(hit.select(*on), on, "left_anti")
    return keys.join(gone, on, "left_anti"), left_models, files


def delete_models(models: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove models only; the keys stay."""
    on = ["id", "owner_user_id"]
    gone = ids.select(*on).distinct()
    return models.join(gone, on, "left_anti"), models.join(gone, on, "left_semi").select(*on, "booklet_pdf_path")


def upsert_models(models: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge processed booklets on (id, owner).

    A match replaces title, language, type, path and question count but keeps
    the creation stamp and the intro page. Of repeated incoming keys the last one counts, as if merged one
    after another; a model created by the first keeps the first creation stamp.
    """
    on = ["id", "owner_user_id"]
    stamp = first_stamp(incoming, on)
    new = latest(incoming, on).drop("created_seq").join(stamp, on).select(*on, F.lit(True).alias("_new"), F.col("title").alias("n_title"), F.col("lang").alias("n_lang"),
                          booklet_type("booklet_type").alias("n_type"), F.col("booklet_pdf_path").alias("n_path"),
                          F.col("question_count").alias("n_count"), F.col("created_seq").alias("n_created"))
    j = models.withColumn("_old", F.lit(True)).join(new, on, "full")
    is_new = F.col("_new").isNotNull()

    def pick(old: str, fresh: str) -> Column:
        return F.when(is_new, F.col(fresh)).otherwise(F.col(old)).alias(old)

    return j.select(
        *on, pick("title", "n_title"), pick("lang", "n_lang"), pick("booklet_type", "n_type"),
        pick("booklet_pdf_path", "n_path"), pick("question_count", "n_count"),
        F.when(F.col("_old").isNull(), 2).otherwise(F.coalesce("intro_page", F.lit(2))).alias("intro_page"),
        F.when(F.col("_old").isNull(), F.col("n_created")).otherwise(F.col("created_seq")).alias("created_seq"),
    )


def first_stamp(incoming: DataFrame, on: list[str]) -> DataFrame:
    """Creation stamp of the first row per key: the one that makes the model."""
    at = F.col("ord") if "ord" in incoming.columns else F.monotonically_increasing_id()
    return incoming.withColumn("_at", at).groupBy(*on).agg(F.min_by("created_seq", "_at").alias("created_seq"))


def update_keys(keys: DataFrame, models: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New title, language and type (null keeps the old type) for a key and its model; the last of repeated changes counts."""
    on = ["id", "owner_user_id"]
    c = latest(changes, on).select(*on, F.col("title").alias("n_title"), F.col("lang").alias("n_lang"), F.col("booklet_type").alias("n_type"))
    hit = keys.select(*on, F.col("booklet_type").alias("_k_type")).join(c, on).withColumn(
        "n_type", F.when(F.col("n_type").isNotNull(), booklet_type("n_type")).otherwise(F.coalesce("_k_type", F.lit("standard")))
    ).drop("_k_type")

    def apply(df: DataFrame) -> DataFrame:
        j = df.join(hit, on, "left")
        new = {old: F.when(F.col("n_type").isNotNull(), F.col(fresh)).otherwise(F.col(old))
               for old, fresh in (("title", "n_title"), ("lang", "n_lang"), ("booklet_type", "n_type"))}
        return j.withColumns(new).select(*df.columns)

    return apply(keys), apply(models)


def bulk_patch(questions: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Set page and marks of many questions; the last of repeated ids wins.

    Returns the questions, the ids updated and the ids not found, each id once
    with the position (``ord``) where it was first asked for.
    """
    asked = items.withColumn("question_id", F.trim("question_id")).filter(F.col("question_id") != "")
    on = ["model_id", "question_id"]
    asked = asked.groupBy(*on).agg(
        F.max_by(F.struct("page_num", "marks"), "ord").alias("_p"), F.min("ord").alias("ord"))
    known = questions.select("model_id", F.col("id").alias("question_id"))
    patched = questions.join(
        asked.select("model_id", F.col("question_id").alias("id"), "_p"), ["model_id", "id"], "left"
    ).withColumn("page_num", F.coalesce(F.col("_p.page_num"), "page_num")).withColumn(
        "marks", F.coalesce(F.col("_p.marks"), "marks")).select(*questions.columns)
    updated = asked.join(known, on, "left_semi").select(*on, "ord")
    missing = asked.join(known, on, "left_anti").select(*on, "ord")
    return patched, updated, missing


def patch_counts(updated: DataFrame, missing: DataFrame) -> DataFrame:
    """How many ids of each model a bulk patch updated and did not find: model_id, updated_count, not_found_count."""
    both = updated.select("model_id", F.lit(1).alias("u"), F.lit(0).alias("m")).unionByName(missing.select("model_id", F.lit(0).alias("u"), F.lit(1).alias("m")))
    return both.groupBy("model_id").agg(F.sum("u").alias("updated_count"), F.sum("m").alias("not_found_count"))


# Reorder outcomes, in the order they are checked.
REORDER_INVALID = "Invalid questions_json."
REORDER_DUPLICATE = "Invalid order: duplicate ids."
REORDER_MISSING = "Invalid order: missing question ids."
REORDER_UNKNOWN = "Invalid order: unknown question ids."


def reorder_check(questions: DataFrame, order: DataFrame) -> DataFrame:
    """One row per requested model: the error, or null when the order is a permutation."""
    q = questions.groupBy("model_id", "id").agg(F.count(F.lit(1)).alias("nq"))
    o = order.groupBy("model_id", "id").agg(F.count(F.lit(1)).alias("no"))
    per_id = q.join(o, ["model_id", "id"], "full")
    stats = per_id.groupBy("model_id").agg(
        F.sum(F.coalesce("nq", F.lit(0))).alias("n_questions"), F.sum(F.coalesce("no", F.lit(0))).alias("n_order"),
        F.max(F.coalesce("no", F.lit(0))).alias("most"),
        F.count_if(F.col("nq").isNull()).alias("unknown"), F.count_if(F.col("no").isNull()).alias("missing"),
        F.count_if(F.col("nq").isNotNull() & (F.col("id").isNull() | (F.trim("id") == ""))).alias("invalid"),
    )
    error = (
        F.when(F.col("n_questions") == 0, "Model not found.")
        .when(F.col("invalid") > 0, REORDER_INVALID).when(F.col("most") > 1, REORDER_DUPLICATE)
        .when(F.col("n_order") != F.col("n_questions"), REORDER_MISSING)
        .when(F.col("unknown") > 0, REORDER_UNKNOWN).when(F.col("missing") > 0, REORDER_MISSING)
    )
    return stats.filter(F.col("n_order") > 0).select("model_id", error.alias("error"))


def reorder(questions: DataFrame, order: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply valid orders and renumber; the second result lists rejected models."""
    checked = reorder_check(questions, order)
    good = checked.filter(F.col("error").isNull()).select("model_id")
    placed = order.join(good, "model_id", "left_semi").select("model_id", "id", F.col("pos").alias("_pos"))
    arranged = questions.join(placed, ["model_id", "id"]).withColumn("pos", F.col("_pos")).drop("_pos")
    untouched = questions.join(good, "model_id", "left_anti")
    return renumber(arranged).select(*questions.columns).unionByName(untouched), checked.filter(F.col("error").isNotNull())


def append_questions(keys: DataFrame, models: DataFrame, questions: DataFrame, incoming: DataFrame):
    """Append questions to (model_id, owner), creating the model from its key if needed.

    Several questions of one model follow each other in the order of ``ord`` (or of the table) and get consecutive
    ids. Returns (models, questions, errors). All questions of a touched model are
    renumbered and its question count is set.
    """
    if "ord" not in incoming.columns:
        incoming = incoming.withColumn("ord", F.monotonically_increasing_id())
    on = ["model_id", "owner_user_id"]
    m = models.select(F.col("id").alias("model_id"), "owner_user_id", F.lit(True).alias("_m"))
    k = keys.select(F.col("id").alias("model_id"), "owner_user_id", F.lit(True).alias("_k"), F.col("title").alias("_kt"),
                    F.col("lang").alias("_kl"), F.col("booklet_type").alias("_kb"))
    routed = incoming.join(m, on, "left").join(k, on, "left")
    errors = routed.filter(F.col("_m").isNull() & F.col("_k").isNull()).select(
        *on, F.lit("Model key not found for this user.").alias("error"))
    good = routed.filter(F.col("_m").isNotNull() | F.col("_k").isNotNull())
    created = good.filter(F.col("_m").isNull()).select(
        F.col("model_id").alias("id"), "owner_user_id", F.col("_kt").alias("title"), F.col("_kl").alias("lang"),
        booklet_type("_kb").alias("booklet_type"), F.lit(None).cast("string").alias("booklet_pdf_path"),
        F.lit(2).alias("intro_page")).distinct()
    top = questions.groupBy("model_id").agg(F.max("pos").alias("_top"), F.coalesce(F.max(question_number()), F.lit(0)).alias("_n"))
    nth = split_rank(good, ["model_id"], ["ord"], [block_of("ord")], "_nth")
    added = nth.join(top, "model_id", "left").select(
        "model_id", (F.coalesce("_top", F.lit(0)) + F.col("_nth")).alias("pos"),
        F.format_string("q-eng-%03d", F.coalesce("_n", F.lit(0)) + F.col("_nth")).alias("id"),
        *[F.col(c) for c in questions.columns if c in incoming.columns and c not in ("model_id", "pos", "id")])
    touched = questions.join(good.select("model_id").distinct(), "model_id", "left_semi")
    rest = questions.join(good.select("model_id").distinct(), "model_id", "left_anti")
    done = renumber(touched.unionByName(added, allowMissingColumns=True))
    counts = count_per(done, ["model_id"], "_n").select(F.col("model_id").alias("id"), F.col("_n").cast("int"))
    all_models = models.unionByName(created, allowMissingColumns=True).join(counts, "id", "left")
    if "question_count" in models.columns:
        all_models = all_models.withColumn("question_count", F.coalesce("_n", "question_count"))
    else:
        all_models = all_models.withColumn("question_count", F.col("_n"))
    return all_models.drop("_n"), done.unionByName(rest), errors


def replace_questions(questions: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace whole questions by id; id, position and number order stay. The last of repeated ids counts."""
    body = [c for c in questions.columns if c not in ("model_id", "id", "pos")]
    incoming = latest(incoming, ["model_id", "id"])
    new = incoming.select("model_id", "id", F.struct(*[F.col(c) for c in body]).alias("_new"))
    replaced = questions.join(new, ["model_id", "id"], "left").select(
        "model_id", "id", "pos",
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in body])
    have_model = questions.select("model_id").distinct().withColumn("_m", F.lit(True))
    errors = incoming.join(questions.select("model_id", "id"), ["model_id", "id"], "left_anti").join(
        have_model, "model_id", "left").select(
        "model_id", "id", F.when(F.col("_m").isNull(), "Model not found").otherwise("Question not found").alias("error"))
    return replaced.select(*questions.columns), errors


def delete_questions(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove the first match of each id and renumber the touched models."""
    hit = questions.join(ids.select("model_id", "id").distinct(), ["model_id", "id"], "left_semi")
    first = hit.groupBy("model_id", "id").agg(F.min("pos").alias("pos"))
    models_hit = first.select("model_id").distinct()
    kept = questions.join(first, ["model_id", "id", "pos"], "left_anti")
    return renumber(kept.join(models_hit, "model_id", "left_semi")).select(*questions.columns).unionByName(
        kept.join(models_hit, "model_id", "left_anti").select(*questions.columns))
