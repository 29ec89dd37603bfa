"""Column-level building blocks: pixel arithmetic, colours, image bytes."""
