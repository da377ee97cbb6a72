"""DataFrame operators: frames in, frames out; nothing is collected."""
