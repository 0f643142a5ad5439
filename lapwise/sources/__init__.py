"""Tables, dimensions and document sinks."""
