"""Tables and files as the operators' inputs."""
