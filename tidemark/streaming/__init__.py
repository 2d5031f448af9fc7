"""The transforms on Structured Streaming: handlers per topic, late side output, idempotent sinks and stateful folds."""
