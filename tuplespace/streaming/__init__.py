"""Structured Streaming: score tuple files as they arrive (the trainer's file stream)."""
