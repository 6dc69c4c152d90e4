"""Research loops around a language model, over many questions at once.

Each loop is a table of questions with their state; a round works on the rows
that are still open, asks the model in Arrow batches and writes the state to
the shared folder, so a loop has as many jobs as rounds, not as questions. A
failed or unreadable answer has the stated default, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake import connectors
from paperlake.functions import ids, questions as Q, text
from paperlake.operators import evidence, retrieval, survey
from paperlake.plans.engine import Engine
from paperlake.session import cut
from paperlake.sources import services

#: Score from which an answer is good enough, and the one counted where a judge fails.
GOOD, NEUTRAL = 8, 5
#: Confidence from which a question counts as answered, failures in a row that lead to a new plan, contextual questions.
ANSWERED, FAILURES, CONTEXTUAL = 0.85, 2, 4
#: Longest text of one paper given to extraction, and the length below which a refusal is dropped.
BODY, REFUSAL = 14_000, 160


def said(answer: Column, schema: str) -> Column:
    """The JSON object in an answer as a struct; null if there is none."""
    return F.from_json(text.json_repaired(text.json_slice(answer)), schema)


def _asked(df: DataFrame, prompt: Column, model: connectors.Model, out: str) -> DataFrame:
    return connectors.completed(df.withColumn("_prompt", prompt), "_prompt", model, out).drop("_prompt")


def rewritten(asked: DataFrame, history: DataFrame, model: connectors.Model) -> DataFrame:
    """qid, q, refined: the question as it is searched, and what it was rewritten to with its conversation (null: as it was).

    history: qid, block. Questions without history are not rewritten; an
    answer of up to three characters, or the question itself, changes nothing.
    """
    both = asked.select("qid", "q").join(history.select("qid", "block"), "qid", "left")
    old = F.coalesce("block", F.lit("")) != ""
    prompt = F.concat("block", F.lit("\n\nCurrent question: "), "q", F.lit("\n\nWrite it as one search query that stands alone. Do not answer it."))
    some = _asked(both.where(old), prompt, model, "_a").withColumn("_a", F.trim("_a"))
    new = F.when((F.length("_a") > 3) & (F.col("_a") != F.col("q")), F.col("_a"))
    done = some.select("qid", F.coalesce(new, "q").alias("q"), new.alias("refined"))
    return done.unionByName(both.where(~old).select("qid", "q", F.lit(None).cast("string").alias("refined")))


def refined(answers: DataFrame, model: connectors.Model, rounds: int = 3) -> DataFrame:
    """qid, answer, score, rounds: drafts judged and improved until a judge gives GOOD or ``rounds`` are over.

    answers: qid, q, context, answer. A judge that fails counts as NEUTRAL,
    one that gives no score as 0; a failed improvement keeps the draft.
    """
    state = cut(answers.select("qid", "q", "context", "answer", F.lit(None).cast("double").alias("score"), F.lit(0).alias("rounds"), F.lit(False).alias("done")))
    about = F.concat(F.lit("\n\nQuestion:\n"), "q", F.lit("\n\nSources:\n"), F.coalesce("context", F.lit("No documents")))
    for n in range(1, rounds + 1):
        judged = _asked(state.where("NOT done"), F.concat(F.lit("Judge this answer. Reply with JSON: overall_score (0 to 10), feedback.\n\n"), F.coalesce("answer", F.lit("")), about), model, "_j")
        j = said(F.col("_j"), "overall_score double")
        score = F.when(j.isNull(), float(NEUTRAL)).otherwise(F.coalesce(j["overall_score"], F.lit(0.0)))
        judged = cut(judged.withColumn("score", score).withColumn("rounds", F.lit(n)))
        good = judged.where(F.col("score") >= GOOD).withColumn("done", F.lit(True)).drop("_j")
        poor = judged.where(F.col("score") < GOOD)
        better = _asked(poor, F.concat(F.lit("Improve this answer by the feedback.\n\n"), F.coalesce("answer", F.lit("")), F.lit("\n\nFeedback:\n"), F.coalesce("_j", F.lit("")), about), model, "_b")
        better = better.withColumn("answer", F.coalesce(F.nullif(F.trim("_b"), F.lit("")), "answer")).drop("_j", "_b")
        state = cut(state.where("done").unionByName(good).unionByName(better))
        if state.where("NOT done").isEmpty():
            break
    return state.select("qid", "answer", "score", "rounds")


def sufficient(asked: DataFrame, docs: DataFrame, model: connectors.Model, top: int = 5, each: int = 1200, most: int = 8000) -> DataFrame:
    """qid, enough, missing (array): whether the first documents answer a question; false where the judge fails or there are none."""
    part = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.left(F.coalesce("full_text", F.lit("")), F.lit(each)))
    shown = docs.where(F.col("place") <= top).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("t")))).alias("d"))
    joined = F.left(F.array_join(F.transform("d", lambda x: x["t"]), "\n\n"), F.lit(most))
    both = asked.select("qid", "q").join(shown.select("qid", joined.alias("_d")), "qid", "left")
    prompt = F.concat(F.lit("Do these documents suffice to answer the question? Reply with JSON: sufficient, missing_aspects.\n\nQuestion: "), "q", F.lit("\n\n"), "_d")
    judged = _asked(both.where("_d IS NOT NULL"), prompt, model, "_a")
    a = said(F.col("_a"), "sufficient boolean, missing_aspects array<string>")
    none = F.array().cast("array<string>")
    yes = judged.select("qid", F.coalesce(a["sufficient"], F.lit(False)).alias("enough"), F.coalesce(a["missing_aspects"], none).alias("missing"))
    return yes.unionByName(both.where("_d IS NULL").select("qid", F.lit(False).alias("enough"), none.alias("missing")))


def contextual(asked: DataFrame, docs: DataFrame, model: connectors.Model) -> DataFrame:
    """qid, phrasings: up to CONTEXTUAL questions for what is missing (asked: qid, q, missing); the question itself where the model fails."""
    part = F.concat(F.lit("Source: "), F.col("paper_id").cast("string"), F.lit("\nKey points: "), F.left(F.coalesce("full_text", F.lit("")), F.lit(500)))
    shown = docs.where("place <= 3").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("t")))).alias("d"))
    both = asked.join(shown, "qid", "left")
    context = F.to_json(F.struct(F.col("q").alias("original_query"), F.transform("d", lambda x: x["t"]).alias("document_summaries"), F.col("missing").alias("missing_aspects")))
    made = _asked(both, F.concat(F.lit("Write search queries that find what is missing. Reply with JSON: queries.\n\nContext: "), context), model, "_a")
    got = F.slice(F.filter(F.coalesce(said(F.col("_a"), "queries array<string>")["queries"], F.array().cast("array<string>")), lambda x: F.trim(x) != ""), 1, CONTEXTUAL)
    return made.select("qid", "q", F.when(F.size(got) > 0, got).otherwise(F.array("q")).alias("phrasings"))


def cascade(engine: Engine, asked: DataFrame, web: connectors.Fetcher | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, outcome) of questions (qid, q) by three stages, each for those the one before left open.

    1: the closest papers; 2: fusion of contextual questions; 3: results of
    ``web`` (at most three) after the papers of the stage before. A stage is
    enough if the model says so. documents: qid, place, paper_id, score,
    full_text, stage. outcome: qid, success, stage (0: none), missing.
    """
    model = engine.model
    cols = ["qid", "place", "paper_id", "score", "full_text"]
    one = cut(engine.basic(asked).select(*cols))
    first = cut(sufficient(asked, one, model))
    done, open_ = first.where("enough"), asked.select("qid", "q").join(first.where("NOT enough").select("qid", "missing"), "qid")
    two = cut(engine.advanced(contextual(open_, one, model)).select(*cols))
    second = cut(sufficient(open_, two, model))
    ok2, left = second.where("enough"), open_.select("qid", "q").join(second.where("NOT enough").select("qid", "missing"), "qid")
    of = lambda docs, who, n: docs.join(who.select("qid"), "qid", "left_semi").withColumn("stage", F.lit(n))
    docs = of(one, done, 1).unionByName(of(two, ok2, 2))
    outcome = lambda who, n: who.select("qid", F.lit(n > 0).alias("success"), F.lit(n).alias("stage"), "missing")
    ends = outcome(done, 1).unionByName(outcome(ok2, 2))
    if web is None:
        return docs, ends.unionByName(outcome(left, 0))
    raw = left.join(connectors.fetched(left, "q", web, "raw"), "q")
    hits = evidence.web_results(raw, "qid", "raw").where("pos < 3")
    known = of(two, left, 3)
    n = known.groupBy("qid").agg(F.max("place").alias("_n"))
    found = cut(hits.join(n, "qid", "left").select(
        "qid", (F.coalesce("_n", F.lit(0)) + F.col("pos") + 1).cast("int").alias("place"), F.lit(None).cast(two.schema["paper_id"].dataType).alias("paper_id"),
        F.lit(None).cast("double").alias("score"), F.col("content").alias("full_text"), F.lit(3).alias("stage"),
    ))
    some = left.join(found.select("qid").distinct(), "qid", "left_semi")
    none = left.join(found.select("qid").distinct(), "qid", "left_anti")
    docs = docs.unionByName(known.join(some.select("qid"), "qid", "left_semi")).unionByName(found)
    return docs, ends.unionByName(outcome(some, 3)).unionByName(outcome(none, 0))


_PLAN = "plan array<string>, queries array<string>"


def _plan(answer: Column, default: Column) -> Column:
    p = said(answer, _PLAN)
    return F.when((F.size(p["queries"]) > 0) & (F.size(p["plan"]) == F.size(p["queries"])), p["queries"]).otherwise(default)


def profound(engine: Engine, asked: DataFrame, cycles: int = 3, web: connectors.Fetcher | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, outcome) of questions (qid, q) researched by plans, step by step, in up to ``cycles`` cycles.

    A plan is a list of searches by the model, or the question's parts. Each
    step is a ``cascade``. After a step with documents the model may find the
    question answered with ANSWERED or more, which ends it; after FAILURES
    failed steps in a row it may end the plan or give new steps for the rest.
    A cycle whose plan is through is followed by another plan. documents: those
    of ``cascade`` with ``step``. outcome: qid, reason (``question_answered``,
    ``plan_complete`` or what the model says ends the plan), steps, cycles.
    """
    model, spark = engine.model, asked.sparkSession
    parts = Q.subqueries(Q.cleaned(F.col("q")))
    ask = F.concat(F.lit("Plan the research of this question. Reply with JSON: plan (purposes), queries.\n\nQuestion: "), "q")
    state = _asked(asked.select("qid", "q"), ask, model, "_a").select(
        "qid", "q", _plan(F.col("_a"), parts).alias("plan"), F.lit(0).alias("pos"), F.lit(1).alias("cycle"), F.lit(0).alias("failed"), F.lit(0).alias("steps"),
        F.lit(None).cast("string").alias("reason"),
    )
    state, kept = cut(state), None
    for _ in range(cycles * 50):  # a plan longer than that is cut short by the loop's end, as ``plan_complete``
        due = state.where("reason IS NULL")
        if due.isEmpty():
            break
        docs, ends = cascade(engine, due.select("qid", F.element_at("plan", F.col("pos") + 1).alias("q")), web)
        docs = cut(docs.join(due.select("qid", F.col("steps").alias("step")), "qid"))
        kept = docs if kept is None else kept.unionByName(docs)
        ends = cut(ends)
        told = sufficient_answer(due, docs, model)
        now = due.join(ends.select("qid", "success"), "qid").join(told, "qid", "left")
        failed = F.when(F.col("success"), 0).otherwise(F.col("failed") + 1)
        more = F.col("pos") + 1 < F.size("plan")
        now = cut(now.withColumn("failed", failed).withColumn("steps", F.col("steps") + 1).withColumn(
            "reason", F.when(F.col("success") & F.coalesce("answered", F.lit(False)), "question_answered")
        ).withColumn("review", F.col("reason").isNull() & (F.col("failed") >= FAILURES) & more))
        look = F.concat(F.lit("The last searches failed. Review the plan. Reply with JSON: should_complete, question_type, plan, queries.\n\nQuestion: "), "q", F.lit("\n\nPlan: "), F.array_join("plan", "; "))
        seen = _asked(now.where("review"), look, model, "_a")
        r = said(F.col("_a"), "should_complete boolean, question_type string, " + _PLAN)
        end = F.coalesce(r["should_complete"], F.lit(False))
        new = _plan(F.col("_a"), F.array().cast("array<string>"))
        seen = seen.withColumn("reason", F.when(end, F.coalesce(r["question_type"], F.lit("limitations_detected")))).withColumn(
            "plan", F.when(F.size(new) > 0, F.concat(F.slice("plan", F.lit(1), F.col("pos") + 1), new)).otherwise(F.col("plan"))
        ).withColumn("failed", F.when(F.size(new) > 0, 0).otherwise(F.col("failed"))).drop("_a")
        now = now.where("NOT review").unionByName(seen).withColumn("pos", F.col("pos") + 1)
        through = F.col("reason").isNull() & (F.col("pos") >= F.size("plan"))
        now = now.withColumn("through", through).withColumn("reason", F.when(through & (F.col("cycle") >= cycles), "plan_complete").otherwise(F.col("reason")))
        again = _asked(now.where("through AND reason IS NULL"), ask, model, "_a").withColumn("plan", _plan(F.col("_a"), parts)).drop("_a")
        again = again.withColumn("pos", F.lit(0)).withColumn("cycle", F.col("cycle") + 1).withColumn("failed", F.lit(0))
        rest = now.where("NOT through OR reason IS NOT NULL")
        state = cut(state.where("reason IS NOT NULL").unionByName(rest.unionByName(again).select(*state.columns)))
    ends = state.select("qid", F.coalesce("reason", F.lit("plan_complete")).alias("reason"), "steps", F.col("cycle").alias("cycles"))
    empty = "qid long, place int, paper_id string, score double, full_text string, stage int, step int"
    return (spark.createDataFrame([], empty) if kept is None else kept), ends


def sufficient_answer(asked: DataFrame, docs: DataFrame, model: connectors.Model) -> DataFrame:
    """qid, answered: whether the model finds the question answered with a confidence of ANSWERED or more."""
    shown = docs.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", F.left(F.coalesce("full_text", F.lit("")), F.lit(1200)).alias("t")))).alias("d"))
    both = asked.select("qid", "q").join(shown, "qid")
    prompt = F.concat(F.lit("Is the question answered? Reply with JSON: answered, confidence.\n\nQuestion: "), "q", F.lit("\n\n"), F.array_join(F.transform("d", lambda x: x["t"]), "\n\n"))
    a = said(F.col("_a"), "answered boolean, confidence double")
    yes = F.coalesce(a["answered"] & (a["confidence"] >= ANSWERED), F.lit(False))
    return _asked(both, prompt, model, "_a").select("qid", yes.alias("answered"))


def extracted(asked: DataFrame, papers: DataFrame, model: connectors.Model, most: int = 8) -> DataFrame:
    """qid, notes: what each of the first papers says to its question, paper by paper, joined in order; no row without any.

    papers: qid, place, title, full_text, abstract. A paper needs a full text
    of 500 or an abstract of 200 characters to be among the first ``most``,
    and 400 characters of either to be read.
    """
    full, abstract = F.trim(F.coalesce("full_text", F.lit(""))), F.trim(F.coalesce("abstract", F.lit("")))
    fit = papers.where((F.length(full) >= 500) | (F.length(abstract) >= 200))
    w = Window.partitionBy("qid").orderBy("place")
    some = fit.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).withColumn("_b", F.when(full != "", full).otherwise(abstract)).where(F.length("_b") >= 400)
    body = F.when(F.length("_b") > BODY, F.concat(F.left("_b", F.lit(BODY)), F.lit("\n[truncated]"))).otherwise(F.col("_b"))
    how = F.when(Q.seeks_workflow(F.col("q")), "Give the steps of the procedure as a numbered list, in the text's order.").otherwise("Give three to eight facts that help to answer, as bullet points.")
    prompt = F.concat(
        F.lit("Research question: "), "q", F.lit("\nPaper ["), F.col("place").cast("string"), F.lit("]: "), F.left(F.coalesce("title", F.lit("Unknown")), F.lit(220)),
        F.lit("\n---\n"), body, F.lit("\n---\n"), how, F.lit(" Use this text only. If it does not help, reply: (no relevant content for this question)"),
    )
    told = _asked(some.join(asked.select("qid", "q"), "qid"), prompt, model, "_a").withColumn("_a", F.trim("_a"))
    refusal = F.lower("_a").contains("no relevant content for this question") & (F.length("_a") < REFUSAL)
    note = F.concat(F.lit("### Paper ["), F.col("place").cast("string"), F.lit("] "), F.left(F.coalesce("title", F.lit("")), F.lit(90)), F.lit("\n"), "_a")
    rows = told.where((F.coalesce("_a", F.lit("")) != "") & ~refusal).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", note.alias("t")))).alias("p"))
    return rows.select("qid", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("notes"))  # at most ``most`` papers a question


def by_address(asked: DataFrame, pages: connectors.Fetcher, contents: connectors.Fetcher, scholar: connectors.Fetcher) -> DataFrame:
    """qid, kind, id, doi, title, abstract, full_text, source, relevance of the paper an address in a question leads to.

    An arXiv page is tried first (its id without version), then the content of
    a DOI, then a record without full text; these three give JSON with title,
    doi, abstract, full_text. Questions without an address, or whose address
    leads nowhere, have no row.
    """
    at = asked.select("qid", services.address_kind(F.col("q")).alias("k")).where("k IS NOT NULL").select(
        "qid", "k.kind", F.when(F.col("k.kind") == "arxiv", F.regexp_replace("k.id", r"v\d+$", "")).otherwise(F.col("k.id")).alias("id")
    )
    at = cut(at.where("kind <> 'web'"))
    shape = "title string, doi string, abstract string, full_text string"

    def tried(rows: DataFrame, source: connectors.Fetcher, name: str, relevance: int, whole: bool) -> DataFrame:
        got = rows.join(connectors.fetched(rows, "id", source, "raw"), "id").select("qid", "kind", "id", F.from_json("raw", shape).alias("p"))
        ok = F.coalesce(F.col("p.full_text"), F.lit("")) != "" if whole else F.col("p").isNotNull()
        own = F.when(F.col("kind") == "doi", F.col("id")).otherwise(F.concat(F.lit("10.48550/arXiv."), "id"))
        label = F.when(F.col("kind") == "arxiv", F.concat(F.lit("arXiv:"), "id")).otherwise(F.col("id"))
        text_ = F.col("p.full_text") if whole else F.lit(None).cast("string")
        return cut(got.where(ok).select(
            "qid", "kind", "id", F.coalesce(F.nullif("p.doi", F.lit("")), own).alias("doi"), F.coalesce(F.nullif("p.title", F.lit("")), label).alias("title"),
            F.coalesce("p.abstract", F.lit("")).alias("abstract"), text_.alias("full_text"), F.lit(name).alias("source"), F.lit(relevance).alias("relevance"),
        ))

    one = tried(at.where("kind = 'arxiv'"), pages, "url_fetch", 5, True)
    two = tried(at.where("kind = 'doi'"), contents, "url_fetch", 5, True)
    whole = one.unionByName(two)
    return whole.unionByName(tried(at.join(whole.select("qid"), "qid", "left_anti"), scholar, "semantic_scholar_fallback", 4, False))


def analysed(papers: DataFrame, question: str, model: connectors.Model, batch: int = 20) -> DataFrame:
    """pid, relevance, concepts, methodology, contribution of papers with an abstract (pid, title, abstract), ``batch`` to a request.

    Papers go to requests by a hash of their id, so no task holds them all;
    an unreadable answer gives no rows for its papers.
    """
    some = papers.where(F.coalesce("abstract", F.lit("")) != "").select(F.col("pid").cast("string").alias("pid"), "title", "abstract")
    parts = -(-max(some.count(), 1) // batch)
    line = F.concat(F.lit("(ID: "), "pid", F.lit(")\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.left("abstract", F.lit(300)))
    held = some.groupBy(F.pmod(F.xxhash64("pid"), F.lit(parts)).alias("b")).agg(F.array_sort(F.collect_list(F.struct("pid", line.alias("l")))).alias("p"))
    split = held.select("b", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("p") - 1, F.lit(batch)), lambda i: F.slice("p", i + 1, F.lit(batch)))).alias("i", "p"))
    ask = F.concat(F.lit(f'Analyse these papers for "{question}". Reply with JSON: analyses (paper_id, relevance_score 1 to 5, key_concepts, methodology, contribution).\n\n'),
                   F.array_join(F.transform("p", lambda x: x["l"]), "\n\n"))
    a = said(F.col("_a"), "analyses array<struct<paper_id:string,relevance_score:double,key_concepts:array<string>,methodology:string,contribution:string>>")
    rows = _asked(split, ask, model, "_a").select("p", F.explode(a["analyses"]).alias("x")).where(F.exists("p", lambda y: y["pid"] == F.col("x.paper_id")))
    return rows.select(F.col("x.paper_id").alias("pid"), F.coalesce("x.relevance_score", F.lit(0.0)).alias("relevance"),
                       F.coalesce("x.key_concepts", F.array().cast("array<string>")).alias("concepts"), "x.methodology", "x.contribution")


def themes(analyses: DataFrame, question: str, model: connectors.Model) -> DataFrame:
    """ord, theme: three to eight themes of all concepts by the model; stated ones where there are no analyses or no concepts."""
    spark = analyses.sparkSession
    plain = survey.default_themes(spark, question, analyses)
    names = [r.theme for r in plain.collect()]  # three at most
    if names:
        return spark.createDataFrame(list(enumerate(names)), "ord int, theme string")
    # the concepts of one survey's papers are one prompt, as the model needs them together
    one = survey.concepts(analyses).agg(F.array_join(F.array_sort(F.collect_list("concept")), ", ").alias("c"))
    got = _asked(one, F.concat(F.lit(f'Name the main research themes (three to eight) on "{question}" among these concepts. Reply with JSON: themes (name, description).\n\n'), "c"), model, "_a")
    a = said(F.col("_a"), "themes array<struct<name:string,description:string>>")
    return got.select(F.posexplode(a["themes"]).alias("ord", "t")).select("ord", F.col("t.name").alias("theme")).where("theme IS NOT NULL")


def assigned(papers: DataFrame, names: DataFrame, model: connectors.Model) -> DataFrame:
    """pid, theme: the themes (ord, theme) the model names for each paper, exactly spelt; all papers go to the first if it names none."""
    listed = names.agg(F.array_sort(F.collect_list(F.struct("ord", "theme"))).alias("t"))
    both = papers.select("pid", "title", "abstract").join(F.broadcast(listed))  # one row of a few themes
    ask = F.concat(F.lit("Which of these themes does the paper belong to? Reply with their names, separated by commas, or None.\n\nThemes: "), F.array_join(F.transform("t", lambda x: x["theme"]), ", "),
                   F.lit("\n\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nAbstract: "), F.left(F.coalesce("abstract", F.lit("")), F.lit(400)))
    told = _asked(both, ask, model, "_a").where("_a IS NOT NULL AND NOT contains(_a, 'None')")
    each = F.array_intersect(F.transform("t", lambda x: x["theme"]), F.transform(F.split("_a", ","), lambda x: F.trim(x)))
    return survey.assigned_or_first(papers, cut(told.select("pid", F.explode(each).alias("theme"))), names)


def surveyed(papers: DataFrame, question: str, model: connectors.Model, as_of_year: int, most: int = 50) -> dict[str, DataFrame]:
    """The phases of a survey over candidates (pid, pos, title, authors, abstract, year, doi, citations).

    ``analyses``, ``themes``, ``assigned``, ``picked`` (pid, reason, place; ``most`` at most) and ``report`` (one row).
    """
    some = cut(papers.where(F.coalesce("abstract", F.lit("")) != "").withColumn("pid", F.col("pid").cast("string")))
    done = cut(analysed(some, question, model))
    names = cut(themes(done, question, model))
    rated = cut(some.join(done.select("pid", "relevance"), "pid", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0))))
    placed = cut(assigned(some, names, model))
    picked = cut(survey.recommended(rated, placed, as_of_year, most))
    report = survey.report_lines(picked.join(some.select("pid", "title", "authors", "year", "doi"), "pid"), "place")
    return {"analyses": done, "themes": names, "assigned": placed, "picked": picked, "report": report}


def searched(services_: list[Callable[[DataFrame], DataFrame]], asked: DataFrame, backup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """qid and paper columns of several services' answers, without repeats per question; ``backup`` is asked where none answers.

    A service is a function from questions (qid, q) to rows (qid, pos, title, doi, citations).
    """
    cols = ["qid", "pos", "title", "doi", "citations"]
    rows = None
    for n, service in enumerate(services_):
        part = service(asked).select(*cols).withColumn("pos", ids.packed(F.lit(n), F.col("pos")))
        rows = part if rows is None else rows.unionByName(part)
    rows = cut(rows)
    if backup is not None:
        missed = asked.join(rows.select("qid").distinct(), "qid", "left_anti")
        rows = cut(rows.unionByName(backup(missed).select(*cols).withColumn("pos", F.col("pos").cast("long"))))
    k = evidence.evidence_key(F.col("doi"), F.col("title"))
    keyed = rows.withColumn("_k", F.when(k == "", F.concat(F.lit("#"), F.col("pos").cast("string"))).otherwise(k))
    w = Window.partitionBy("qid", "_k").orderBy(F.coalesce("citations", F.lit(0)).desc(), "pos")
    return retrieval.ranked(
        keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_k").withColumn("score", -F.col("pos").cast("double")), "qid", "pos"
    ).drop("score")
