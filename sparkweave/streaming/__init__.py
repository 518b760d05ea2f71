"""Streaming: nothing in the engine is a stream; graphs are read whole and iterated on."""
