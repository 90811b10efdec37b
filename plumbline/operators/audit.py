"""Audit events: a typed row for each event of a run, from the columns of a table.

A constructor takes the fields of its event as columns and gives a struct of EVENT's shape; null
fields stay null, ``details`` lists what else belongs to the event as text. Durations are
milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EVENT = ("event_type", "workflow_id", "agent", "success", "duration_ms", "message", "details", "error")
KINDS = {"event_type": "string", "workflow_id": "string", "agent": "string", "success": "boolean", "duration_ms": "long", "message": "string", "details": "map<string,string>", "error": "string"}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _said(form: str, *parts: Column) -> Column:
    """``form`` with its {} filled in."""
    pieces = form.split("{}")
    out = [F.lit(pieces[0])]
    for p, after in zip(parts, pieces[1:]):
        out += [_text(p), F.lit(after)]
    return F.concat(*out)


def event(kind: str, message: Column, success: Column | bool = True, details: dict[str, Column] | None = None, **fields: Column) -> Column:
    """A struct of EVENT's shape; details that are null are left out."""
    made = F.create_map(*[x for k, v in (details or {}).items() for x in (F.lit(k), v.cast("string"))]) if details else F.create_map()
    held = {"event_type": F.lit(kind), "success": success if isinstance(success, Column) else F.lit(success), "message": message, "details": F.map_filter(made.cast("map<string,string>"), lambda _, v: v.isNotNull()), **fields}
    return F.struct(*[held.get(n, F.lit(None)).cast(KINDS[n]).alias(n) for n in EVENT])


def agent_start(agent: Column, workflow: Column, params: Column) -> Column:
    return event("agent.start", _said("Agent {} started", agent), True, {"params": F.to_json(params)}, agent=agent, workflow_id=workflow)


def agent_complete(agent: Column, workflow: Column, ms: Column, score: Column, errors: Column) -> Column:
    return event("agent.complete", _said("Agent {} completed", agent), errors == 0, {"score": score, "error_count": errors}, agent=agent, workflow_id=workflow, duration_ms=ms)


def agent_error(agent: Column, workflow: Column, error: Column) -> Column:
    return event("agent.error", _said("Agent {} failed", agent), False, agent=agent, workflow_id=workflow, error=error)


def llm_request(provider: Column, model: Column, tokens: Column) -> Column:
    return event("llm.request", _said("LLM request to {}/{}", provider, model), True, {"provider": provider, "model": model, "prompt_tokens": tokens})


def llm_response(provider: Column, model: Column, ms: Column, tokens_in: Column, tokens_out: Column) -> Column:
    details = {"provider": provider, "model": model, "input_tokens": tokens_in, "output_tokens": tokens_out, "total_tokens": tokens_in + tokens_out}
    return event("llm.response", _said("LLM response from {}/{}", provider, model), True, details, duration_ms=ms)


def llm_error(provider: Column, model: Column, error: Column) -> Column:
    return event("llm.error", _said("LLM error from {}/{}", provider, model), False, {"provider": provider, "model": model}, error=error)


def file_generate(path: Column, size: Column, language: Column) -> Column:
    return event("file.generate", _said("Generated file: {}", path), True, {"path": path, "size": size, "language": language})


def db_snapshot(tables: Column, rows: Column, ms: Column) -> Column:
    return event("db.snapshot", _said("Database snapshot: {} tables, {} rows", F.size(tables), rows), True, {"tables": F.array_join(tables, ","), "row_count": rows}, duration_ms=ms)


def compiled(language: Column, files: Column, success: Column, ms: Column, errors: Column) -> Column:
    return event("compile", _said("Compiled {} {} files", files, language), success, {"language": language, "file_count": files, "errors": F.array_join(errors, "\n")}, duration_ms=ms)


def fixture_run(name: Column, passed: Column, ms: Column, error: Column) -> Column:
    return event("fixture.run", _said("Fixture {}: {}", name, passed), passed, {"fixture_name": name}, duration_ms=ms, error=F.when(error != "", error))


def proof_pack(path: Column, fixtures: Column, passed: Column) -> Column:
    details = {"output_path": path, "fixture_count": fixtures, "pass_count": passed, "fail_count": fixtures - passed}
    return event("proofpack.generate", _said("Generated proof pack: {}/{} passed", passed, fixtures), passed == fixtures, details)


def workflow_start(workflow: Column, source: Column, target: Column, path: Column) -> Column:
    return event("workflow.start", _said("Workflow started: {} -> {}", source, target), True, {"source_lang": source, "target_lang": target, "input_path": path}, workflow_id=workflow)


def workflow_end(workflow: Column, success: Column, ms: Column, score: Column, path: Column) -> Column:
    return event("workflow.end", F.concat(F.lit("Workflow completed: score="), F.format_string("%.2f", score)), success, {"score": score, "output_path": path}, workflow_id=workflow, duration_ms=ms)
