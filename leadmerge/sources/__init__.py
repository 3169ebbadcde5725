"""Readers, batch intake, state tables and sinks."""
