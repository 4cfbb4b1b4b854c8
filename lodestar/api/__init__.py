"""What users call: a client, tools by name, retrievers, plugins and a command line."""
