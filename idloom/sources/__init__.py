"""Readers and source templates that turn raw tables into the event log contracts."""
