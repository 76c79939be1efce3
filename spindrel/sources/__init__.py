"""Readers and writers of the formats that documents, embeddings and indexes come in."""
