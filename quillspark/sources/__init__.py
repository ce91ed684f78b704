"""Tables and their schemas, event frames, and sinks."""
